"""DuckDB spellings of the cleaning steps.

RE2 has neither back-references nor Unicode ``\\s``, so both are written out.
"""

WS = r"[\s\x0b\x{1C}-\x{1F}\x{85}\p{Z}]"
NON_WS = r"[^\s\x0b\x{1C}-\x{1F}\x{85}\p{Z}]"
EMOJI = (r"[\x{1F1E0}-\x{1F1FF}\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}"
         r"\x{1F680}-\x{1F8FF}\x{2600}-\x{27BF}]")
WORD = r"[\p{L}\p{N}_]"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def urls(x: str) -> str:
    return sub(x, f"http{NON_WS}+|www{NON_WS}+", "")


def mentions(x: str) -> str:
    return sub(x, f"@{WORD}+", "")


def hashtags(x: str) -> str:
    return sub(x, f"#({WORD}+)", r"\1")


def emoji(x: str, keep: bool = False) -> str:
    return sub(x, EMOJI, " <emoji> " if keep else " ")


def emphasis(x: str, keep: bool = True) -> str:
    if not keep:
        return sub(x, "[!?]+", " ")
    return sub(sub(x, "!+", " <excl> "), r"\?+", " <ques> ")


def runs(x: str) -> str:
    """Keep a character unless it equals the two before it; line feeds always stay."""
    chars = f"string_split({x}, '')"
    triples = (f"list_zip({chars}, list_concat([NULL], {chars}), "
               f"list_concat([NULL, NULL], {chars}))")
    kept = (f"list_filter({triples}, lambda t: t[1] IS NOT NULL AND (t[1] = chr(10) OR "
            f"NOT coalesce(t[1] = t[2] AND t[1] = t[3], false)))")
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string(list_transform({kept}, lambda t: t[1]), '') END"


def vowels(x: str) -> str:
    for v in "aeiouAEIOU":
        x = sub(x, f"{v}{v}+", v)
    return x


def charset(x: str, profile: str = "social") -> str:
    ws = r"\s\x0b\x{1C}-\x{1F}\x{85}\p{Z}"
    if profile == "social":
        return sub(x, rf"[^a-zA-Z0-9{ws}\x{{900}}-\x{{97F}}<>_]", " ")
    return sub(x, rf"[^a-zA-Z0-9{ws}]", "")


def squash(x: str) -> str:
    return f"trim({sub(f'lower({x})', f'{WS}+', ' ')})"


def key(x: str) -> str:
    return sub(f"lower({strip(f'coalesce({x}, {chr(39)*2})')})", f"{WS}+", " ")


def clean(x: str, keep_emojis: bool = False, keep_emphasis: bool = True,
          repeated: bool = True, profile: str = "social") -> str:
    """The whole cleaner as one expression over a cheap column reference."""
    y = hashtags(mentions(urls(x)))
    if profile == "social":
        y = emphasis(emoji(y, keep_emojis), keep_emphasis)
        if repeated:
            y = vowels(runs_of(y))
    return f"coalesce({squash(charset(y, profile))}, '')"


def runs_of(y: str) -> str:
    """``runs`` over a costly expression, evaluated once."""
    return f"list_transform([{y}], lambda z: {runs('z')})[1]"
