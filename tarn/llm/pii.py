"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from the base patterns (email, ip, card, phone) and from looser ones:
addresses beyond ASCII or spelled out, IPv6, national phone numbers, and secrets, which are a
kind of their own. Four labelers vote on each candidate (yes, no, abstain): the base patterns
with their checks, gazetteers, the words before the span, and its shape.
Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability per class; a logistic span classifier is then trained on the patterns'
posteriors and decides which loose candidates become spans. Base spans always stay.

Positions are code points: matches and the gaps between them come from one pattern, and a
window sums their lengths. The patterns run over every row; spans are then worked out once
for each distinct text (md5) that has candidates, so a group of copies counts once, and come
back to the rows by a salted join. The counts that EM and the classifier see are a bounded
table of vote patterns.

Defined results: a null or empty text has no spans; repeated rows get equal spans; an empty
table gives no rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_names, stored

KINDS = ("email", "ip", "card", "phone")
#: The kinds of all spans, in their order at one place.
ALL_KINDS = (*KINDS, "secret")
#: Patterns (fixed values). They match what the plain patterns match, but start only where
#: those can, so no text is scanned twice over.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WIDE_EMAIL = r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
SPELLED_EMAIL = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[({]at[\])}]\x20?[a-z0-9-]++(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[a-z0-9-]++)++"
IPV6 = r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:.])"
WIDE_PHONE = r"(?<![0-9+(.-])(?<![0-9][\x20])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|\(?0[0-9]{2,4}\)?[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5}|0[0-9](?:[\x20.][0-9]{2}){4})(?![\x20().-]?[0-9])"
SECRET = r"(?i)(?<![0-9a-z])(?:[0-9a-f]{32,128}+|(?:sk|pk|ghp|gho|xox[bap]|akia)[_-]?[0-9a-z]{16,64}+)(?![0-9a-z])"
#: name -> (kind that its spans get, pattern, what a text must have for a match; None: see NEEDED).
FINDERS = {
    "email": ("email", EMAIL, "@"),
    "ip": ("ip", IP, "."),
    "card": ("card", CARD, None),
    "phone": ("phone", PHONE, "+"),
    "wide_email": ("email", WIDE_EMAIL, "@"),
    "spelled_email": ("email", SPELLED_EMAIL, None),
    "ipv6": ("ip", IPV6, None),
    "wide_phone": ("phone", WIDE_PHONE, None),
    "secret": ("secret", SECRET, None),
}
#: Short patterns that every match of the finder meets.
NEEDED = {
    "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]",
    "spelled_email": r"(?i)[\[({]at[\])}]",
    "ipv6": ":[0-9A-Fa-f]{1,4}:",
    "wide_phone": r"[0-9]{2}[\x20.)/-][0-9(]|[0-9]\)",
    "secret": "(?i)[0-9a-f]{32}|(?:sk|pk|ghp|gho|xox[bap]|akia)[_-]?[0-9a-z]{16}",
}
#: Gazetteers (fixed values): top-level domains, first digits of card issuers, calling codes.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "us", "ca", "ch", "at", "nl")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Words before a span that speak for or against a person's data (fixed values).
FOR = r"(?i)(?:mail|phone|tel|mobile|call|contact|card|visa|address|ip|user|name|fax|from|host)\W*$"
AGAINST = r"(?i)(?:token|key|hash|sha|md5|version|isbn|order|part|serial|id|commit)\W*$"
FOR_SECRET = r"(?i)(?:token|key|secret|password|passwd|pwd|auth|bearer|credentials?)\W*$"
AGAINST_SECRET = r"(?i)(?:hash|sha[0-9]*|md5|digest|checksum|commit|rev|etag|uuid|crc)\W*$"
LABELERS = ("base", "gazetteer", "context", "shape")
#: Cuts that a broadcast may hold (16 MB); more are joined by a shuffle.
BROADCAST_CUTS = 500_000
#: Parts that a hot text's rows are dealt into.
SALTS = 16
EM_ROUNDS, FIT_ROUNDS = 30, 200


def _located(text: Column, name: str) -> Column:
    """Matches in order: name, number, characters since the last match, value, what stands before."""
    _, pattern, needed = FINDERS[name]
    pair = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda v, gap: F.struct(v.alias("value"), F.length(gap).cast("long").alias("gap"), F.right(gap, F.lit(24)).alias("before")),
    )
    rows = F.transform(
        F.filter(pair, lambda x: x["value"].isNotNull()),
        lambda x, i: F.struct(F.lit(name).alias("finder"), i.cast("int").alias("i"), x["value"].alias("value"), x["gap"].alias("gap"), x["before"].alias("before")),
    )
    has = F.contains(text, F.lit(needed)) if needed else text.rlike(NEEDED[name])
    if name == "wide_email":
        has = has & text.rlike(r"[^\x00-\x7f]")
    return F.when(has, rows).otherwise(F.array().cast(_FOUND))


_FOUND = "array<struct<finder:string,i:int,value:string,gap:bigint,before:string>>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def doubled(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(finder: Column, value: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return (
        F.when(finder == "email", F.lit(True))
        .when(finder == "ip", value.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"))
        .when(finder == "card", _luhn(digits))
        .when(finder == "phone", F.length(digits).between(9, 15))
        .otherwise(F.lit(False))
    )


def candidates(texts: DataFrame) -> DataFrame:
    """All candidate spans of the distinct texts (tk, found): tk, finder, kind, start, end, value, before, valid."""
    rows = texts.select("tk", F.inline("found"))
    span = F.length("value").cast("long")
    upto = Window.partitionBy("tk", "finder").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.element_at(F.create_map(*(F.lit(x) for k, v in FINDERS.items() for x in (k, v[0]))), F.col("finder"))
    return rows.withColumn("end", F.sum(F.col("gap") + span).over(upto)).select(
        "tk", "finder", kind.alias("kind"), (F.col("end") - span).alias("start"), "end", "value", "before", _valid(F.col("finder"), F.col("value")).alias("valid")
    )


def votes(spans: DataFrame) -> DataFrame:
    """The labelers' votes on each candidate: 1, 0, or -1 for none."""
    finder, value, kind = F.col("finder"), F.col("value"), F.col("kind")
    digits = F.regexp_replace(value, "[^0-9]", "")
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    base = vote(F.col("valid"), finder.isin(*KINDS))
    domain = F.lower(F.regexp_extract(value, r"\.([\p{L}\p{N}-]+)$", 1)).isin(*TOP_DOMAINS)
    gazetteer = (
        F.when(kind == "email", vote(domain, F.lit(False)))
        .when(kind == "card", vote(digits.rlike(ISSUERS), F.lit(True)))
        .when(finder == "phone", vote(value.rlike(CALLING_CODES), F.lit(True)))
        .when(kind == "ip", vote(finder == "ipv6", value.rlike(r"^(?:0|127|255)\.")))
        .when(finder == "wide_phone", vote(digits.rlike("^0[1-9]"), digits.rlike("^(?:00|1)")))
        .when(kind == "secret", vote(F.length(value).isin(32, 40, 64, 128) | value.rlike("(?i)^(?:sk|pk|ghp|gho|xox|akia)"), F.lit(True)))  # of known keys
        .otherwise(-1)
    )
    before = F.col("before")
    context = F.when(kind == "secret", vote(before.rlike(FOR_SECRET), before.rlike(AGAINST_SECRET))).otherwise(vote(before.rlike(FOR), before.rlike(AGAINST)))
    shape = (
        F.when(kind == "email", vote(F.length(value).between(6, 80), F.lit(True)))
        .when(kind == "card", vote(F.length(digits).isin(15, 16), F.length(digits).isin(12, 17, 18)))
        .when(kind == "phone", vote(value.rlike(r"\([0-9]{3,5}\)|[0-9]{3}[\x20.-][0-9]{4}$|^0[0-9]"), F.length(digits) < 10))
        .when(kind == "secret", vote(value.rlike("[0-9].*[0-9].*[0-9].*[0-9]") & value.rlike("(?i)[a-z].*[a-z].*[a-z]"), F.lit(True)))
        .otherwise(-1)
    )
    return spans.withColumns(dict(zip(LABELERS, (base, gazetteer, context, shape), strict=True)))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict], list[float]]:
    """EM over vote patterns and their counts: prior, each labeler's P(vote | class), each pattern's posterior."""
    prior, posts = 0.5, []
    tables = [{(v, y): 0.7 if v == y else 0.3 for v in (0, 1) for y in (0, 1)} for _ in LABELERS]
    for _ in range(EM_ROUNDS):
        posts = []
        for pattern, _ in patterns:
            odds = log(prior / (1 - prior)) + sum(log(t[v, 1] / t[v, 0]) for t, v in zip(tables, pattern, strict=True) if v >= 0)
            posts.append(1 / (1 + exp(-max(-30.0, min(30.0, odds)))))
        total = sum(n for _, n in patterns)
        prior = (1 + sum(n * p for (_, n), p in zip(patterns, posts, strict=True))) / (2 + total)
        for k, t in enumerate(tables):
            for y in (0, 1):
                mass = {v: 1.0 + sum(n * (p if y else 1 - p) for (pat, n), p in zip(patterns, posts, strict=True) if pat[k] == v) for v in (0, 1)}
                for v in (0, 1):
                    t[v, y] = mass[v] / (mass[0] + mass[1])
    return prior, tables, posts


def train_classifier(patterns: list[tuple[tuple[str, ...], tuple[int, ...], int]]) -> dict[str, float]:
    """Weights of the logistic span classifier, fitted to the posteriors of vote patterns.

    `patterns`: (finder, kind), votes and count of each pattern that occurs."""
    _, _, posts = reliabilities([(v, n) for _, v, n in patterns])
    total = sum(n for *_, n in patterns) or 1
    rows = [(["bias", f"kind={names[1]}", *(f"{k}={v}" for k, v in zip(LABELERS, vote, strict=True) if v >= 0)], p, n / total) for (names, vote, n), p in zip(patterns, posts, strict=True)]
    weights = {f: 0.0 for fs, _, _ in rows for f in fs}
    for _ in range(FIT_ROUNDS):
        slope = {f: 1e-4 * w for f, w in weights.items()}
        for fs, p, share in rows:
            miss = 1 / (1 + exp(-sum(weights[f] for f in fs))) - p
            for f in fs:
                slope[f] += share * miss
        weights = {f: w - 2.0 * slope[f] for f, w in weights.items()}
    return weights


def score(weights: dict[str, float]) -> Column:
    """The classifier as a column over the votes."""
    terms = F.lit(weights.get("bias", 0.0))
    for f, w in weights.items():
        if f != "bias":
            name, value = f.split("=")
            terms = terms + F.when(F.col(name).cast("string") == value, F.lit(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-terms))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tk (md5 of the text) and its raw matches."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("tk"), text.alias("text"))
    return rows.select("doc_id", "tk", F.concat(*(_located(F.col("text"), k) for k in FINDERS)).alias("found"))


def find_spans(found: DataFrame) -> DataFrame:
    """tk, kind, start, end, base (whether a base pattern found it) and score of all spans of
    the distinct texts of keyed()."""
    texts = found.filter(F.size("found") > 0).groupBy("tk").agg(F.first("found").alias("found"))
    spans = stored(votes(candidates(texts)))
    counts = spans.groupBy("finder", "kind", *LABELERS).count().collect()  # at most finders x 3 ** labelers rows
    weights = train_classifier(sorted(((r.finder, r.kind), tuple(r[k] for k in LABELERS), r["count"]) for r in counts))
    loose = ~F.col("finder").isin(*KINDS)  # what fails its check is evidence for the labelers, but never a span
    taken = spans.withColumn("score", score(weights)).filter(F.col("valid") | (loose & (F.col("score") >= 0.5)))
    return taken.groupBy("tk", "kind", "start", "end").agg(F.max("valid").alias("base"), F.max("score").alias("score"))


def _salted(rows: DataFrame, lists: DataFrame, key: str, salt: str) -> DataFrame:
    """rows left-joined with lists (one row a key), where any key may hold most rows: each list
    is there SALTS times, and a row meets one of them."""
    times = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(times, [key, salt], "left")


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and spans: array of (start, kind_no, end, kind, base, score), ordered."""
    found = stored(keyed(docs, id_col, text_col))
    kind_no = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")).cast("int")
    lists = find_spans(found).groupBy("tk").agg(F.sort_array(F.collect_list(F.struct("start", kind_no.alias("kind_no"), "end", "kind", "base", "score"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string,base:boolean,score:double>>")
    some = _salted(found.filter(F.size("found") > 0).select("doc_id", "tk"), lists, "tk", "salt").select("doc_id", F.coalesce("spans", empty).alias("spans"))
    return some.unionByName(found.filter(F.size("found") == 0).select("doc_id", empty.alias("spans")))


def digests(detected: DataFrame) -> DataFrame:
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def of_kind(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return detected.select(
        "doc_id",
        *(of_kind(k) for k in KINDS),
        F.sha2(named(base).cast("binary"), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans are one."""
    found = stored(keyed(docs, id_col, text_col))
    before = Window.partitionBy("tk").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    runs = find_spans(found).withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(upto))
    runs = runs.groupBy("tk", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"))).alias("kind"))
    tk, salt, cut = fresh_names(docs, "tk", "salt", "cuts")
    cuts = runs.groupBy(F.col("tk").alias(tk)).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias(cut))
    cuts = stored(cuts)
    text = F.col(text_col)
    after = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["end"])
    pieces = F.transform(
        F.col(cut),
        lambda c, i: F.concat(text.substr((after(i) + 1).cast("int"), (c["start"] - after(i)).cast("int")), F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))),
    )
    rest = text.substr((F.element_at(cut, -1)["end"] + 1).cast("int"), F.length(text))
    keys = docs.withColumn(tk, F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    few = (cuts.agg(F.sum(F.size(cut))).first()[0] or 0) <= BROADCAST_CUTS
    joined = keys.join(F.broadcast(cuts), tk, "left") if few else _salted(keys, cuts, tk, salt)
    return joined.withColumn(text_col, F.when(F.col(cut).isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest))).select(*docs.columns)
