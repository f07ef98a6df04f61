from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import line_dedup, near_dup, pii, toxicity
from tests.llm.conftest import PASSAGE


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i in sorted(sets):
        common = Counter(o for g in sets[i] for o in by[g])
        for g in sets[i]:
            by[g].append(i)
        for o, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[o]) - n) and find(i) != find(o):
                a, b = sorted((find(i), find(o)))
                root[b] = a
    return {i: find(i) for i in sets}


def chains(n=60, words=60, seed=6):
    """A group whose members drift apart: near to some, far from others."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = list(rng.choice(vocabulary, words))
    rows = []
    for i in range(n):
        if i % 20 == 0:
            base = list(rng.choice(vocabulary, words))
        base = base.copy()
        base[int(rng.integers(words))] = str(rng.choice(vocabulary))
        rows.append((1000 + i, " ".join(base)))
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(spark, odd, small, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = [(r.doc_id + 5000, r.text) for r in small.collect()] + chains() + [(1, "one two"), (2, "One  TWO"), (3, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    sets = sets_of(rows)
    want = components(sets)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_odd(odd, empty):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == 0 and not by[1].kept and by[None].component_id is None and by[None].kept
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (2, 3, 4))
    assert near_dup.near_duplicates(empty).count() == 0


def test_posterior_bounds():
    least = near_dup.least_matches(0.75, 1e-5)
    assert least == sorted(least) and all(0 < m < n * 0.75 for m, n in zip(least, range(32, 129, 32), strict=True))
    a = np.random.default_rng(1).integers(0, 1 << 32, (4, 128), dtype=np.uint32)
    b = a.copy()
    b[1, ::2] ^= 1
    b[2] ^= 1
    at, matches = near_dup.plausible(a, b, least)
    assert at.tolist() == [0, 3] and matches.tolist() == [128, 128]


def test_large_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.label for r in near_dup.components(chain).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def test_lines(odd, empty):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {*odd.columns, "n_lines_cut"}
    by = {r.doc_id: r for r in rows}
    before = {r.doc_id: r.text for r in odd.collect()}
    assert by[9].text == before[9] and by[None].text == before[None] and by[2].text is None and by[3].text == ""
    assert [r.text for r in rows if r.doc_id == 10] == ["other beginning and more of it"] * 2
    assert by[0].text == before[0] and by[8].text == before[8]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_keep_text(small):
    for r in small.collect():
        assert "".join(line_dedup.lines_of(r.text)) == r.text


def test_lines_brute_force(spark):
    """Every passage of 50 words that came before is cut, wherever it is set in."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    sentence = lambda: " ".join([word().capitalize(), *(word() for _ in range(9))]) + "."
    shared = [" ".join(sentence() for _ in range(6)) for _ in range(4)]
    rows, clean = [], []
    for i in range(80):
        own = [sentence() for _ in range(5)]
        clean.append(" ".join(own))
        at = int(rng.integers(0, 40))
        words = clean[-1].split(" ")
        rows.append((i, " ".join([*words[:at], shared[i % 4], *words[at:]])))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == [rows[i][1] for i in range(4)]
    assert [got[i] for i in range(4, 80)] == clean[4:]


def cut_by_rule(rows, min_words=30):
    """Texts without the lines of runs of min_words words that stand in an earlier place, by comparing all runs."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = line_dedup.lines_of(text)
        plain, own, cut = [x.strip() for x in lines], {}, set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(plain[a:b])
                if sum(x.count(" ") + 1 for x in run) >= min_words:
                    if run in seen or own.setdefault(run, b) <= a:
                        cut.update(range(a, b))
        seen |= own.keys()
        out[i] = "".join(x for k, x in enumerate(lines) if k not in cut)
    return out


def made_up(rng):
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    return lambda n: " ".join([word().capitalize(), *(word() for _ in range(n - 1))]) + "."


def cut(spark, rows):
    return {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_one_line_passages(spark):
    """A repeated line of 30 words goes, whatever its neighbours."""
    sentence = made_up(np.random.default_rng(4))
    shared = [sentence(n) for n in (30, 31, 45, 70)]
    rows = [(i, " ".join([sentence(8), sentence(5), shared[i % 4], sentence(6), sentence(9)])) for i in range(60)]
    got = cut(spark, rows)
    assert got == cut_by_rule(rows)
    assert all((shared[i % 4] in got[i]) == (i < 4) for i in range(60))


def test_passages_with_lines_met_before(spark):
    """Lines of a passage that stand alone in earlier documents do not hide the passage's own source."""
    rng = np.random.default_rng(5)
    sentence = made_up(rng)
    passage = [sentence(6) for _ in range(12)]
    rows = [(i, " ".join([sentence(7), passage[i % 12], sentence(7)])) for i in range(24)]
    rows += [(100 + i, " ".join([sentence(7), *passage, sentence(7)])) for i in range(3)]
    got = cut(spark, rows)
    assert got == cut_by_rule(rows)
    assert got[100] == rows[24][1] and not any(x in got[i] for x in passage for i in (101, 102))


def test_lines_of_many_sources_stay(spark):
    """Common lines in a row are no repeated passage unless they stand so in one earlier place."""
    rng = np.random.default_rng(6)
    sentence = made_up(rng)
    common = [sentence(5) for _ in range(40)]
    rows = [(i, " ".join([sentence(5), common[i], sentence(5)])) for i in range(40)]
    rows += [(100 + i, " ".join(rng.permutation(common)[:14])) for i in range(6)]
    rows += [(200, rows[41][1]), (201, " ".join([common[0], common[1]] * 9))]
    got = cut(spark, rows)
    assert got == cut_by_rule(rows)
    assert all(got[i] == t for i, t in rows[:46]) and got[200] == ""


def test_lines_are_short(small):
    """No line has more words than LINE_WORDS, and lines of texts together are those of each alone."""
    texts = [r.text or "" for r in small.collect()] + ["", "\n", " a", "É", "x \n\n\n y", "\n", "a b c d e f g h i j k " * 40]
    data, start, end, bare, words, row = line_dedup.line_places([t.encode() for t in texts])
    for i, t in enumerate(texts):
        lines = line_dedup.lines_of(t)
        assert [data[a:b].decode() for a, b in zip(start[row == i], end[row == i], strict=True)] == lines
        assert words[row == i].tolist() == [len(x.split()) for x in lines] and max(words[row == i], default=0) <= line_dedup.LINE_WORDS
    assert [data[a:b].decode() for a, b in zip(start, bare, strict=True)] == [x.rstrip(" \n") for t in texts for x in line_dedup.lines_of(t)]


def test_windows_share_fingerprints():
    """Wherever a passage of 30 words in whole lines is set in, its windows have the same fingerprint, and are found."""
    rng = np.random.default_rng(7)
    sentence = made_up(rng)
    for n in (30, 37, 64):
        passage = sentence(n)
        texts = [" ".join([*(sentence(9) for _ in range(i)), passage, sentence(9)]) for i in range(5)]
        row, line, size, least, run = line_dedup.windows_of(texts, 30)
        own = [{(a, *b) for a, b in zip(least[row == i].tolist(), run[row == i].tolist(), strict=True)} for i in range(5)]
        shared = set.intersection(*own)
        plain = [[x.strip() for x in line_dedup.lines_of(t)] for t in texts]
        windows = [{tuple(plain[i][a : a + b]) for a, b in zip(line[row == i], size[row == i], strict=True)} for i in range(5)]
        assert shared and len(shared) == len(set.intersection(*windows))
        assert [len(o) for o in own] == [len(w) for w in windows]


def test_passages_without_capitals_or_stops(spark):
    """A passage within one long run of lower-case words goes, but for its edges; the words around it stay."""
    rng = np.random.default_rng(8)
    words = lambda n: ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n)]
    shared = words(120)
    rows = [(i, " ".join([*words(40 + i), *shared, *words(50 - i)])) for i in range(20)]
    got = cut(spark, rows)
    assert got == cut_by_rule(rows) and got[0] == rows[0][1]
    for i, text in rows[1:]:
        own = [w for w in text.split() if w not in shared]
        left = got[i].split()
        assert [w for w in left if w not in shared] == own and len(left) - len(own) <= 70


def test_random_partial_repeats(spark):
    """Random stretches of earlier texts, own ones too, against the comparison of all runs."""
    rng = np.random.default_rng(9)
    sentence, texts = made_up(rng), []
    for _ in range(60):
        parts = [sentence(int(rng.integers(3, 14))) for _ in range(6)]
        for _ in range(2):
            source = (texts[int(rng.integers(len(texts)))] if texts and rng.random() < 0.8 else " ".join(parts)).split(" ")
            a = int(rng.integers(max(1, len(source) - 20)))
            parts.insert(int(rng.integers(len(parts))), " ".join(source[a : a + int(rng.integers(20, 60))]))
        texts.append(" ".join(parts))
    rows = list(enumerate(texts))
    got = cut(spark, rows)
    assert got == cut_by_rule(rows)
    assert sum(got[i] != t for i, t in rows) > 20


def test_lines_need_windows(odd):
    with pytest.raises(ValueError, match="min_words"):
        line_dedup.dedup_lines(odd, min_words=line_dedup.LINE_WORDS)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_pii(spark, odd, small, empty):
    hard = ["a@b.com_x@y.co.uk é@ü.de", "1.2.3.4.5.6.7.8 300.1.1.1 010.0.0.001", "4111 1111 1111 1111 " * 9 + "12 " * 50, "+12-" * 60 + "9", "🙂 +49 (30) 1234-5678 x@y", "+1+12 345 678 901 2", "4111-1111-1111-1111-1"]
    docs = odd.select("doc_id", "text").unionByName(small.selectExpr("doc_id + 100 as doc_id", "text")).unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    names = [*pii.KINDS]
    want = Counter()
    for r in docs.collect():
        found = base_spans(r.text or "")
        n = Counter(k for _, k, _ in found)
        want[(r.doc_id, n[0], n[1], n[2], n[3], hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in found).encode()).hexdigest())] += 1
    rows = pii.digests(pii.detect(docs)).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    assert pii.digests(pii.detect(empty)).count() == 0


def test_added_spans(spark):
    """Looser candidates become spans where the labelers speak for them, and stay out where they do not."""
    common = [f"write to jo{i}@mail{i % 9}.example.com or call +1 ({200 + i}) 555-0{100 + i}, ip 10.0.{i}.7" for i in range(60)]
    loose = {
        1: ("mail jörg.müller@bücher.de now", "email", 5, 26),
        2: ("contact jane.doe [at] example [dot] com please", "email", 8, 39),
        3: ("call (212) 555-0188 today", "phone", 5, 19),
        4: ("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up", "ip", 5, 44),
        5: ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "secret", 9, 49),
        6: ('TOKEN = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962" END', "secret", 9, 49),
    }
    against = {20: "at 12:30:45 on 2024-01-02", 21: "order 123 456", 22: "me at example dot com", 23: "card 4111 1111 1111 1112"}
    rows = [(100 + i, t) for i, t in enumerate(common)] + [(i, t[0]) for i, t in loose.items()] + [*against.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digests(pii.detect(docs)).collect()}
    for i, (_, kind, start, end) in loose.items():
        assert got[i].spans == f"{kind}:{start}:{end}" and got[i].n_spans == 1, i
    assert all(got[i].spans == "" and got[i].n_spans == 0 for i in against)
    assert got[5].n_secret == 1 and all(got[i].base_sha256 == hashlib.sha256(b"").hexdigest() for i in loose)


def test_planted_spans_are_found(spark, small):
    """Spans planted in running text, half of them after no telling word: recall by kind, and nothing where nothing was planted."""
    rng = np.random.default_rng(21)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(map(chr, rng.integers(97, 123, 7)))
    makers = {
        "email": lambda: f"{name()}.{name()}@{name()}.com",
        "ip": lambda: ".".join(str(x) for x in rng.integers(1, 255, 4)),
        "phone": lambda: f"+1 ({rng.integers(201, 989)}) 555-0{number(3)}",
        "wide_email": lambda: f"jörg.{name()}@{name()}.de",
        "spelled_email": lambda: f"{name()} [at] {name()} dot com".replace(" dot ", " [dot] "),
        "ipv6": lambda: ":".join(f"{x:04x}" for x in rng.integers(0, 65536, 8)),
        "wide_phone": lambda: f"({rng.integers(201, 989)}) 555-0{number(3)}",
        "secret": lambda: hashlib.sha1(name().encode()).hexdigest(),
    }
    clean = [" ".join(name() for _ in range(40)) for _ in range(100)]
    rows, planted = [(i, t) for i, t in enumerate(clean)], {}
    for k, make in enumerate(makers):
        for j in range(40):
            before = " ".join(name() for _ in range(12)) + (" contact " if j % 2 and k < 7 else " token " if j % 2 else " ")
            value = makers[make]()
            doc = 1000 * (k + 1) + j
            planted[doc] = (make, f"{pii.FINDERS[make][0]}:{len(before)}:{len(before) + len(value)}")
            rows.append((doc, f"{before}{value} " + " ".join(name() for _ in range(12))))
    got = {r.doc_id: r.spans.split(",") for r in pii.digests(pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(got[i] == [""] for i in range(100))
    hits = Counter(make for doc, (make, span) in planted.items() if span in got[doc])
    assert all(hits[k] == 40 for k in pii.KINDS if k in makers), hits
    assert all(hits[k] >= 36 for k in makers), hits


@pytest.mark.parametrize("limit", [500_000, 0])
def test_redact_hot_text(spark, monkeypatch, limit):
    """Copies of one text, by broadcast and by the salted join."""
    monkeypatch.setattr(pii, "BROADCAST_CUTS", limit)
    docs = spark.createDataFrame([(i, "ip 10.0.0.1 and a@b.com" if i % 3 else f"none {i}") for i in range(300)], "doc_id long, text string").withColumns({"tk": F.lit("t"), "salt": F.lit(3), "cuts": F.lit("c")})
    rows = pii.redact(docs).collect()
    assert len(rows) == 300 and rows[0].asDict().keys() == {*docs.columns} and all((r.tk, r.salt, r.cuts) == ("t", 3, "c") for r in rows)
    assert {r.text for r in rows if r.doc_id % 3} == {"ip [IP] and [EMAIL]"}
    assert sum(r.n_spans == 2 for r in pii.digests(pii.detect(docs)).collect()) == 200


def test_cards_and_secrets_however_spaced(spark):
    """Cards in pairs or single digits, and secrets without three digits in a row, are found in texts that hold nothing else."""
    cards = ["41 11 11 11 11 11 11 11", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "41-11-11-11-11-11-11-11", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"]
    docs = spark.createDataFrame([(i, f"pay with {c} now") for i, c in enumerate(cards)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.digests(pii.detect(docs)).collect()}
    for i, c in enumerate(cards):
        want = hashlib.sha256(f"card:9:{9 + len(c)}".encode()).hexdigest()
        assert rows[i].n_card == 1 and rows[i].base_sha256 == want
    assert {r.text for r in pii.redact(docs).collect()} == {"pay with [CARD] now"}
    secret = spark.createDataFrame([(0, "key " + "ab" * 16)], "doc_id long, text string")
    assert [x["finder"] for r in pii.keyed(secret).collect() for x in r.found] == ["secret"]


def test_redact(odd, empty):
    rows = {r.doc_id: r for r in pii.redact(odd).collect()}
    assert rows[8].text == "mail [EMAIL] or [PHONE], card [CARD], ip [IP]." and rows[2].text is None and rows[3].text == ""
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count() and pii.redact(empty).count() == 0


def test_reliabilities():
    patterns = [((1, 1, 1, 1), 50), ((0, 0, 0, 0), 50), ((1, 1, 0, 1), 9), ((-1, -1, -1, -1), 3), ((0, 0, 1, 0), 7)]
    prior, tables, posts = pii.reliabilities(patterns)
    assert posts[0] > 0.9 > 0.1 > posts[1] and posts[2] > 0.5 > posts[4] and 0.3 < prior < 0.7
    assert tables[0][1, 1] > tables[2][1, 1]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    words = [f"calm{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(800):
        bad = i % 5 == 0
        text = [*rng.choice(words, 30), *(["vile", "nasty", "rotten"][: 2 + i % 2] if bad else [])]
        rows.append((i, " ".join(rng.permutation(text))))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled, odd, empty):
    docs, labels = labelled
    scorer = toxicity.fit(docs, labels)
    rows = toxicity.digests(toxicity.score(docs, scorer)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.predicted == (r.doc_id % 5 == 0) and 0 <= r.score <= 1 for r in held) and len(rows) == 800
    assert toxicity.score(odd, scorer).count() == odd.count() and toxicity.score(empty, scorer).count() == 0
    assert toxicity.fit(empty, labels).score("any") == (0.0, [])
    kept = {r.doc_id for r in toxicity.not_toxic(odd, scorer).collect()}
    assert {2, 3, 4, None} <= kept  # null and blank texts are never rejected
    many = labels.withColumn("toxic", F.lit(1)).unionByName(labels.limit(0))
    assert toxicity.fit(docs, many).score("")[0] < toxicity.THRESHOLD
    copies = spark.createDataFrame([(5, "vile calm1 nasty"), (6, "vile calm1 nasty"), (5, "vile calm1 nasty")], "doc_id long, text string")
    assert len({r.score for r in toxicity.score(copies, scorer).collect()}) == 1
    none = labels.filter("toxic = 0")
    assert toxicity.fit(docs, none).score("vile nasty")[0] == pytest.approx(0.0, abs=1e-3)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_toxic_rows_are_found(spark, sf):
    """Small inputs keep their whole vocabulary: toxic rows are told apart, and every text with a known word has neighbours."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.digests(toxicity.score(docs, toxicity.fit(docs, labels))).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    toxic, clean = ([r for r in rows if r.toxic == y] for y in (1, 0))
    assert len(toxic) >= 2 and sum(r.predicted for r in toxic) > len(toxic) / 2.5
    assert sum(r.predicted for r in clean) < len(clean) / 10
    assert sum(not r.evidence for r in rows) <= len(rows) / 50
    mean = lambda some: sum(r.score for r in some) / len(some)
    assert mean(toxic) > 3 * mean(clean)


def test_every_term_is_kept(spark):
    rows = [(i, f"word{i} common" if i % 2 else f"bad{i} shared") for i in range(6)]
    labels = [(i, i % 2) for i in range(6)]
    scorer = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    used = [i for i in range(6) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert [e for e, _, _ in scorer.score(f"word{used[0]} bad{used[0]}")[1]] and len(scorer.weight) >= len(used)
    for i in used:
        example, _, cosine = scorer.score(rows[i][1])[1][0]
        assert example == i and cosine == pytest.approx(1, abs=1e-5)


def test_neighbours_are_exact(labelled):
    """Against all cosines, for texts of few and of many words; blocks that the bounds leave out change nothing."""
    scorer = toxicity.fit(*labelled)
    index, m = scorer.index, len(scorer.weight)
    dense = np.zeros((index.n, m))
    dense[np.repeat(np.arange(index.n), np.diff(index.starts)), index.terms] = index.weights
    rng = np.random.default_rng(5)
    terms, weights = [], []
    for _ in range(200):
        t = np.sort(rng.choice(m, min(m, int(rng.integers(0, 40))), replace=False))
        w = (1 + np.log(rng.integers(1, 4, len(t)))) * scorer.weight[t]
        terms.append(t)
        weights.append(w / max(np.sqrt((w * w).sum()), 1e-30))
    cuts = np.cumsum([0, *map(len, terms)])
    found = index.nearest(cuts, np.concatenate(terms), np.concatenate(weights), 10)
    for t, w, (at, cosines) in zip(terms, weights, found, strict=True):
        every = np.round(dense[:, t] @ w, 9)
        want = np.lexsort((np.arange(index.n), -every))[:10]
        want = want[every[want] > 0]
        assert np.allclose(cosines, every[want], atol=1e-8)
        assert np.allclose(every[at], every[want], atol=1e-8)
    assert index.blocks_computed < index.blocks_met


def test_scores_brute_force(labelled):
    """Score, calibration and evidence from plain statements of the rule: all cosines, leave-one-out votes, pooled steps."""
    docs, labels = labelled
    scorer = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id: float(r.toxic) for r in labels.collect()}
    used = [i for i in sorted(texts) if zlib.crc32(str(i).encode()) % 4 != 2]
    df = Counter(w for t in texts.values() for w in set(t.split()))
    share = sum(toxic[i] for i in used) / len(used)
    n = Counter(w for i in used for w in set(texts[i].split()))
    n1 = Counter(w for i in used if toxic[i] for w in set(texts[i].split()))
    z = {w: (n1[w] - n[w] * share) / (n[w] * share * (1 - share) * (1 - n[w] / len(used)) + 1) ** 0.5 for w in n}
    idf = {w: np.log((len(texts) + 1) / (df[w] + 1)) + 1 for w in n}

    def vector(text):
        v = {w: (1 + np.log(k)) * idf[w] * (1 + z[w] ** 2) for w, k in Counter(text.split()).items() if w in n}
        size = sum(x * x for x in v.values()) ** 0.5
        return {w: x / size for w, x in v.items()}

    examples = {i: vector(texts[i]) for i in used}

    def nearest(text, without=None):
        v = vector(text)
        cosines = [(-round(sum(x * e.get(w, 0) for w, x in v.items()), 6), i) for i, e in examples.items() if i != without]
        return [(i, -c) for c, i in sorted(cosines)[: toxicity.NEIGHBOURS] if c < 0]

    def vote(found):
        weight = [1 / (0.05 + 1 - min(c, 1)) for _, c in found]
        return (sum(w * toxic[i] for w, (i, _) in zip(weight, found, strict=True)) + share) / (sum(weight) + 1)

    votes = np.array([vote(nearest(texts[i], i)) for i in used])
    assert np.allclose(np.interp(votes, scorer.x, scorer.y), np.interp(votes, *toxicity.isotonic(votes, np.array([toxic[i] for i in used]))), atol=2e-2)
    for i in range(0, 800, 37):
        found = nearest(texts[i])
        score, evidence = scorer.score(texts[i])
        assert score == pytest.approx(np.interp(vote(found), scorer.x, scorer.y), abs=2e-2)
        assert [c for _, _, c in evidence] == pytest.approx([c for _, c in found[: toxicity.EVIDENCE]], abs=1e-5)


def test_isotonic_pools_ties():
    """Against the min-max formula of rising steps, with ties in every order."""
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 30):
        for _ in range(40):
            x, y = rng.integers(0, 6, n) / 5, rng.integers(0, 2, n).astype(float)
            at = sorted(set(x.tolist()))
            mean = lambda i, j: y[(x >= at[i]) & (x <= at[j])].mean()
            value = [max(min(mean(i, k) for k in range(m, len(at))) for i in range(m + 1)) for m in range(len(at))]
            pools = {}
            for a, v in zip(at, value, strict=True):
                pools.setdefault(round(v, 9), []).extend(x[x == a].tolist())
            px, py = toxicity.isotonic(x, y)
            assert py == pytest.approx(sorted(pools)) and px == pytest.approx([np.mean(pools[v]) for v in sorted(pools)])
            mixed = rng.permutation(n)
            again = toxicity.isotonic(x[mixed], y[mixed])
            assert np.allclose(again[0], px) and np.allclose(again[1], py)


def test_examples_are_bounded(spark, labelled):
    """Versions of one id are one example, and bytes are bounded; the choice does not depend on the order of rows."""
    docs, labels = labelled
    many = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" zz"))))
    one = toxicity.fit(docs, labels)
    assert len(toxicity.fit(many, labels).ids) <= len(one.ids)
    few = toxicity.fit(docs, labels, max_bytes=20_000)
    assert 0 < len(few.ids) < len(one.ids) and set(few.ids.tolist()) == set(toxicity.fit(docs.repartition(7), labels, max_bytes=20_000).ids.tolist())


def masked(text, spans):
    """The text with each stretch of overlapping spans replaced by the kind of its first, longest one."""
    out, at = "", 0
    spans = sorted(spans, key=lambda x: (x["start"], -x["end"]))
    while spans:
        first, end = spans[0], spans[0]["end"]
        while spans and spans[0]["start"] < end:
            end = max(end, spans.pop(0)["end"])
        out, at = f"{out}{text[at : first['start']]}[{first['kind'].upper()}]", end
    return out + text[at:]


def test_pipeline(spark, odd, small, empty):
    """Each stage against a plain statement of its rule, over all that the stage before kept."""
    import corpus_pipeline
    from tests.llm.test_tokens import WORD, plain

    sf = "/root/testdata/sf0.001"
    docs = small
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = near_dup.stored(stage(spark, docs, sf))
        assert out.columns == small.columns, name
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
        if name == "toxicity":
            scorer = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            want = {i: t for i, t in before.items() if next(iter(scorer.scores([t or ""])))[0] < toxicity.THRESHOLD}
        if name == "line_dedup":
            cut = cut_by_rule([(i, t or "") for i, t in before.items()])
            want = {i: t for i, t in cut.items() if t == (before[i] or "") or t.strip()}
        if name == "near_dedup":
            classes = components(sets_of(before.items()))
            want = {i: t for i, t in before.items() if classes[i] == i}
        if name == "pii":
            spans = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
            want = {i: masked(t, spans[i]) for i, t in before.items()}
            assert not any(base_spans(t) for t in after.values())
        assert after == want, name
        docs = out
    library = plain(WORD)
    ids = defaultdict(bytes)
    for r in corpus_pipeline.run(spark, sf).orderBy("doc_id", "start").collect():
        ids[r.doc_id] += bytes(r.ids)
    assert ids == {i: np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t in after.items()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
        assert stage(spark, odd, sf).count() > 0
