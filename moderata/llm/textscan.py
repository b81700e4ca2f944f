"""Token boundaries by finite-state transducers over code-point classes.

A text becomes an array of symbols (class of the code point, and what follows
it where the pattern looks ahead). A transducer with at most eight states reads
the symbols and marks the places where a token begins. Its transitions are
functions from state to state; they are composed block by block, the blocks'
functions by a prefix scan, and a second pass with every block's true starting
state emits the marks. No regular expression is run.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
# Unicode White_Space other than the space itself (fixed values).
BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
          0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Symbols. LONG and SHORT are apostrophes that a contraction of three or two
# characters may follow; white space is told apart by what follows it.
(S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_SPACE_RUN, S_SPACE_END, S_BLANK_RUN, S_BLANK_END) = range(9)
N_SYMBOLS = 9
SYMBOL_OF = np.array([S_LETTER, S_NUMBER, S_OTHER, S_SPACE_RUN, S_BLANK_RUN], np.uint8)  # by class
FIRST = 16  # added to the symbol of a text's first code point

START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
BLOCK = 256


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(sys.maxunicode + 1):
        kind = kinds.get(unicodedata.category(chr(cp))[0])
        if kind is not None:
            out[cp] = kind
    out[list(BLANKS)] = BLANK
    out[0x20] = SPACE
    return out


def _step_attached(state: int, symbol: int) -> tuple[int, bool]:
    """Tokens take one leading space; white space keeps its last character for what follows."""
    if state in (ONE_MORE, TWO_MORE) and symbol == S_LETTER:
        return (START if state == ONE_MORE else ONE_MORE), False
    if symbol == S_LETTER:
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if symbol == S_OTHER or symbol in (S_SHORT, S_LONG) and state in (IN_OTHERS, AFTER_SPACE):
        return IN_OTHERS, state not in (IN_OTHERS, AFTER_SPACE)
    if symbol in (S_SHORT, S_LONG):
        return (ONE_MORE if symbol == S_SHORT else TWO_MORE), True
    if symbol in (S_SPACE_RUN, S_BLANK_RUN):
        return IN_BLANKS, state != IN_BLANKS
    return (AFTER_SPACE if symbol == S_SPACE_END else START), True


def _step_words(state: int, symbol: int) -> tuple[int, bool]:
    """Runs of letters, single numbers, runs of others; white space stands alone."""
    if state in (ONE_MORE, TWO_MORE) and symbol == S_LETTER:
        return (START if state == ONE_MORE else ONE_MORE), False
    if symbol == S_LETTER:
        return IN_LETTERS, state != IN_LETTERS
    if symbol == S_OTHER or symbol in (S_SHORT, S_LONG) and state == IN_OTHERS:
        return IN_OTHERS, state != IN_OTHERS
    if symbol in (S_SHORT, S_LONG):
        return (ONE_MORE if symbol == S_SHORT else TWO_MORE), True
    return START, True


def compile_table(step) -> tuple[bytes, bytes]:
    """(next state << 5, begins) for every byte ``state << 5 | symbol``."""
    following, begins = bytearray(256), bytearray(256)
    for code in range(256):
        state, symbol = code >> 5, code & 31
        if symbol & 15 < N_SYMBOLS:
            to, begin = step(START if symbol & FIRST else state, symbol & 15)
            following[code], begins[code] = to << 5, begin or bool(symbol & FIRST)
        else:
            following[code] = state << 5  # padding
    return bytes(following), bytes(begins)


ATTACHED = compile_table(_step_attached)
WORDS = compile_table(_step_words)
PADDING = 15


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``firsts`` are the places where texts begin."""
    kind = classes()[points]
    n = len(kind)
    last = np.zeros(n, bool)  # no character of the same text follows
    last[firsts[firsts > 0] - 1] = True
    last[n - 1:] = True
    blank = kind >= SPACE
    before_token = np.zeros(n, bool)
    before_token[:-1] = ~blank[1:]
    before_token &= ~last
    out = SYMBOL_OF[kind]
    out[blank & before_token] += 1
    marks = np.flatnonzero(points == ord("'"))
    marks = marks[~last[marks]]
    if len(marks):
        after = points[marks + 1]
        out[marks[np.isin(after, [ord(c) for c in "stmd"])]] = S_SHORT
        longer = marks[~last[marks + 1]]
        pair = points[longer + 1].astype(np.int64) << 32 | points[longer + 2]
        out[longer[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]] = S_LONG
    out[firsts] |= FIRST
    return out


def begins(symbol: np.ndarray, table: tuple[bytes, bytes]) -> np.ndarray:
    """Where tokens begin: block functions, their prefix scan, and emission."""
    following, emits = table
    n = len(symbol)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, PADDING, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    # Every block as a function: where it leads from each of the eight states.
    maps = np.repeat((np.arange(8, dtype=np.uint8) << 5)[:, None], blocks, axis=1)
    for col in columns:
        maps = np.frombuffer((maps | col).tobytes().translate(following), np.uint8).reshape(8, blocks)
    maps = (maps >> 5).T.copy()
    reach = 1
    while reach < blocks:  # inclusive scan under composition
        joined = maps.copy()
        joined[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        maps, reach = joined, reach * 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = maps[:-1, START] << 5
    out = np.empty((BLOCK, blocks), np.uint8)
    for i, col in enumerate(columns):
        code = (state | col).tobytes()
        out[i] = np.frombuffer(code.translate(emits), np.uint8)
        state = np.frombuffer(code.translate(following), np.uint8)
    return out.T.reshape(-1)[:n].view(bool)


def slices(texts: list[str], table: tuple[bytes, bytes]):
    """Cut texts into tokens.

    Returns the UTF-8 bytes of all texts, the byte offset of every token's
    beginning (with the end appended), the class of its first code point, and
    for each text the number of the token it begins with (with the end appended).
    Empty texts have no token.
    """
    joined = "".join(texts)
    data = joined.encode("utf-8")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    if not joined:
        return data, np.zeros(1, np.int64), np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    firsts = (ends - lengths)[lengths > 0]
    at = np.flatnonzero(begins(symbols(points, firsts), table))
    if len(data) == len(points):
        offsets = np.append(at, len(data))
    else:
        width = np.ones(len(points), np.int8)
        for limit in (0x7F, 0x7FF, 0xFFFF):
            width += points > limit
        offsets = np.append(0, np.cumsum(np.add.reduceat(width, at, dtype=np.int64)))
    token_of = np.searchsorted(at, np.append(0, ends))
    return data, offsets, classes()[points[at]], token_of


def groups(texts: list[str], size: int = 1 << 21):
    """Slices (from, to) of ``texts`` of about ``size`` characters, a longer text alone."""
    a = n = 0
    for b, t in enumerate(texts, 1):
        n += len(t)
        if n >= size or b == len(texts):
            yield a, b
            a, n = b, 0


def chunks(texts, size: int = 1 << 22):
    """Lists of (number of the text, part) of about ``size`` characters.

    Longer texts are cut before a single space between two other characters: a
    token begins there whatever the state before it. A text without such a
    place stays whole.
    """
    held, n = [], 0
    for i, text in enumerate(texts):
        while len(text) > size:
            cut = size
            while True:
                cut = text.find(" ", cut)
                if cut < 0 or cut + 1 >= len(text):
                    cut = -1
                    break
                if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                    break
                cut += 1
            if cut < 0:
                break
            held.append((i, text[:cut]))
            yield held
            held, n, text = [], 0, text[cut:]
        held.append((i, text))
        n += len(text)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held
