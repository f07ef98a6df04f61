"""Text as columns: tokens, sentences, claims, set similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and word lists that results depend on (fixed values).
ASCII_WORD = r"[a-zA-Z0-9]+(?:[._'-][a-zA-Z0-9]+)*"
CJK_RUN = r"[一-鿿㐀-䶿]+"
PLAIN_TOKEN = r"[a-z0-9]+|[一-鿿]"
SPACE = r"[\s\u0085   -     　]"
CLAIM_END = r"(?<=[。！？!?；;\n])"
CHUNK_END = r"(?<=[。！？!?；;])"
HEDGES = ("可能", "也许", "或许", "大概", "似乎", "建议", "希望", "应该考虑")
CONNECTIVES = ("综上", "总之", "以上", "也就是说", "换句话说")
BULLET = r"^\s*(?:[-*•]|\d+[.、)])\s*"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def filled(c: Column) -> Column:
    """Whether anything is left after strip(); reads up to the first such character."""
    return c.rlike(f"[^{SPACE[1:]}")


def normalize(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def tokens(c: Column, bigrams: bool = True) -> Column:
    """Words of letters and digits, then every character and character pair of CJK runs."""
    low = F.lower(F.coalesce(c, F.lit("")))

    def grams(run: Column) -> Column:
        def at(i: Column) -> Column:
            one = F.substring(run, i, F.lit(1))
            if not bigrams:
                return F.array(one)
            return F.when(i < F.length(run), F.array(one, F.substring(run, i, F.lit(2)))).otherwise(F.array(one))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(run)), at))

    words = F.regexp_extract_all(low, F.lit(ASCII_WORD), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(CJK_RUN), F.lit(0))
    return F.concat(words, F.flatten(F.transform(runs, grams)))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def plain_tokens(c: Column) -> Column:
    """The tokens of the extractive roles: letters and digits, or one CJK character."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(PLAIN_TOKEN), F.lit(0))


def plain_set(c: Column) -> Column:
    return F.array_distinct(plain_tokens(c))


def sentences(c: Column, end: str = CLAIM_END) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), end), strip)
    return F.filter(parts, lambda s: s != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: p != "")


def is_claim(s: Column) -> Column:
    """An assertion: long enough, no question, no hedge, no bare connective."""
    body = strip(F.regexp_replace(s, BULLET, ""))
    return (
        (F.length(body) >= 4)
        & ~body.rlike("[？?]$")
        & ~body.rlike(rf"^\s*(?:{'|'.join(HEDGES)})")
        & ~body.rlike(rf"^\s*(?:{'|'.join(CONNECTIVES)})\s*[,，]?\s*$")
    )


def claims(c: Column) -> Column:
    return F.filter(sentences(c), is_claim)


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def coverage(a: Column, b: Column) -> Column:
    """Share of set a that is in set b; 0 if a is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(common(a, b) / F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    both = common(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def align_score(claim: Column, span: Column) -> Column:
    """0.6 coverage + 0.4 Jaccard of two token sets."""
    cover = F.when(F.size(span) == 0, 0.0).otherwise(coverage(claim, span))
    return F.lit(0.6) * cover + F.lit(0.4) * jaccard(claim, span)


def set_cosine(a: Column, b: Column) -> Column:
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, 0.0).otherwise(common(a, b) / (F.sqrt(F.size(a).cast("double")) * F.sqrt(F.size(b).cast("double"))))


def hard_windows(c: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters, each `overlap` into the one before, until the end is reached."""
    step = max(1, size - overlap)
    last = F.ceil(F.greatest(F.length(c) - size, F.lit(0)) / step).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(cut)
