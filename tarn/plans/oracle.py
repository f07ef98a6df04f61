"""DuckDB SQL that states the named queries independently, over the same tables."""

from __future__ import annotations

from functools import reduce

from ..operators import reason
from . import queries as Q

W = "[a-zA-Z0-9]+(?:[._''-][a-zA-Z0-9]+)*"
SPACE = "[ \\t\\n\\x0b\\f\\r\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{W}')"


def tset(x: str) -> str:
    return f"list_distinct({tok(x)})"


def pset(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def inter(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def jac(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {inter(a, b)} / (len({a}) + len({b}) - {inter(a, b)}) END)"


def cov(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 THEN 0.0 ELSE {inter(a, b)} / len({a}) END)"


def align(a: str, b: str) -> str:
    return f"(0.6::DOUBLE * {cov(a, b)} + 0.4::DOUBLE * {jac(a, b)})"


def setcos(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {inter(a, b)} / (sqrt(len({a})::DOUBLE) * sqrt(len({b})::DOUBLE)) END)"


def sents(x: str) -> str:
    """Sentences as a list: cut after the marks, stripped, not blank."""
    cut = f"regexp_replace({x}, '([。！？!?；;\n])', concat('\\1', chr(1)), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def is_claim(s: str) -> str:
    body = strip(f"regexp_replace({s}, '^\\s*(?:[-*•]|\\d+[.、)])\\s*', '')")
    return (
        f"(length({body}) >= 4 AND NOT regexp_matches({body}, '[？?]$') AND NOT regexp_matches({body}, '^\\s*(?:可能|也许|或许|大概|似乎|建议|希望|应该考虑)')"
        f" AND NOT regexp_matches({body}, '^\\s*(?:综上|总之|以上|也就是说|换句话说)\\s*[,，]?\\s*$'))"
    )


SPANS = "spans AS (SELECT doc_id AS span_id, coalesce(text, '') AS text FROM documents), asked AS (SELECT item_id AS query_id, text FROM benchmark)"
POSTINGS = f"""{SPANS},
words AS (SELECT span_id, {tok('text')} AS t FROM spans),
lens AS (SELECT span_id, len(t) AS dl FROM words),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT span_id, term, count(*) AS tf FROM (SELECT span_id, unnest(t) AS term FROM words) GROUP BY ALL),
terms AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stats)"""
SPARSE = f"""{POSTINGS},
qterms AS (SELECT query_id, unnest({tset('text')}) AS term FROM asked),
bm AS (SELECT query_id, span_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))), 6) AS score
       FROM qterms JOIN terms USING (term) JOIN post USING (term) JOIN lens USING (span_id), stats GROUP BY ALL),
sparse AS (SELECT query_id, span_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, span_id) AS rk FROM bm WHERE score > 0 QUALIFY rk <= 40)"""
NEAR = f"""sets AS (SELECT span_id, {tset('text')} AS st FROM spans), qsets AS (SELECT query_id, {tset('text')} AS qt FROM asked),
shared AS (SELECT query_id, span_id, count(*) AS c FROM (SELECT query_id, unnest(qt) AS term FROM qsets) JOIN (SELECT span_id, unnest(st) AS term FROM sets) USING (term) GROUP BY ALL),
near AS (SELECT query_id, span_id, round(c / (sqrt(len(qt)::DOUBLE) * sqrt(len(st)::DOUBLE)), 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(c / (sqrt(len(qt)::DOUBLE) * sqrt(len(st)::DOUBLE)), 6) DESC, span_id) AS rk
         FROM shared JOIN sets USING (span_id) JOIN qsets USING (query_id) QUALIFY rk <= 40)"""
SIGNALS = """ent AS (SELECT query_id, round(CASE WHEN n <= 1 THEN 0 ELSE (ln(s) - vl / s) / ln(n) END, 6) AS entropy FROM (SELECT query_id, sum(score) AS s, sum(score * ln(score)) AS vl, count(*) AS n FROM sparse WHERE score > 0 GROUP BY query_id)),
mar AS (SELECT query_id, round(coalesce(least(1, greatest((max(score) FILTER (rk = 1) - max(score) FILTER (rk = 2)) / 0.20, 0)), 0), 6) AS margin FROM near GROUP BY query_id),
there AS (SELECT DISTINCT query_id, unnest(st) AS term FROM near JOIN sets USING (span_id)),
lex AS (SELECT q.query_id, round(coalesce(count(t.term) / nullif(count(q.term), 0), 0), 6) AS lexical FROM (SELECT query_id, unnest(qt) AS term FROM qsets) q LEFT JOIN there t ON q.query_id = t.query_id AND q.term = t.term GROUP BY q.query_id),
weights AS (SELECT query_id, coalesce(entropy, 0) AS entropy, coalesce(margin, 0) AS margin, coalesce(lexical, 0) AS lexical,
  round(1 - round(greatest(0.1, least(0.9, 0.5 + 0.25 * coalesce(lexical, 0) - 0.20 * coalesce(entropy, 0) - 0.15 * coalesce(margin, 0))), 6), 6) AS w_dense,
  round(greatest(0.1, least(0.9, 0.5 + 0.25 * coalesce(lexical, 0) - 0.20 * coalesce(entropy, 0) - 0.15 * coalesce(margin, 0))), 6) AS w_sparse
  FROM asked LEFT JOIN lex USING (query_id) LEFT JOIN ent USING (query_id) LEFT JOIN mar USING (query_id))"""


def rrf(w_dense: str, w_sparse: str, join: str) -> str:
    return f"""both_lists AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.span_id, s.span_id) AS span_id, d.rk AS rd, s.rk AS rs
  FROM near d FULL JOIN sparse s ON d.query_id = s.query_id AND d.span_id = s.span_id),
fusedall AS (SELECT query_id, span_id, round(coalesce({w_dense} / (60 + rd), 0) + coalesce({w_sparse} / (60 + rs), 0), 6) AS fused FROM both_lists {join}),
fused AS (SELECT query_id, span_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, span_id) AS rk FROM fusedall QUALIFY rk <= 40)"""


FUSED = f"{SPARSE}, {NEAR}, {SIGNALS}, {rrf('w_dense', 'w_sparse', 'JOIN weights USING (query_id)')}"


#: Remainders of single bytes under the reflected polynomial of CRC-32.
CRC_STEPS = [reduce(lambda r, _: r >> 1 ^ 0xEDB88320 * (r & 1), range(8), byte) for byte in range(256)]


def crc(x: str) -> str:
    """CRC-32 of an ASCII text, byte by byte."""
    codes = f"list_transform(string_split({x}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, c: xor(a >> 8, {CRC_STEPS}[(xor(a, c) & 255) + 1])), 4294967295)"


def counted(name: str, rows: str) -> str:
    """{name}_c: features and pairs of features of rows (id, text) with their counts."""
    return f"""{name}_w AS (SELECT id, {tok('text')} AS t FROM ({rows})),
{name}_c AS MATERIALIZED (SELECT id, feature, count(*) AS tf FROM (SELECT id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '#' || t[i + 1]))) AS feature FROM {name}_w) GROUP BY ALL)"""


def hashed(name: str) -> str:
    """{name}_v: entries (id, idx, w) of unit vectors of {name}_c under the weights of the corpus."""
    return f"""{name}_f AS (SELECT feature, {crc('feature')} % 384 AS idx, CASE WHEN {crc("feature || '|s'")} % 2 = 0 THEN 1 ELSE -1 END AS sign FROM (SELECT DISTINCT feature FROM {name}_c)),
{name}_s AS (SELECT id, idx::INT AS idx, sum(sign * coalesce(idf, ln(1 + (n + 0.5) / 0.5)) * (1 + ln(tf))) AS w FROM {name}_c JOIN {name}_f USING (feature) LEFT JOIN weight USING (feature), total GROUP BY ALL),
{name}_v AS MATERIALIZED (SELECT id, idx, coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY id)), 0), w) AS w FROM {name}_s)"""


WEIGHTED = f"""{counted('span', 'SELECT span_id AS id, text FROM spans')}, total AS (SELECT count(*) AS n FROM spans),
weight AS MATERIALIZED (SELECT feature, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT feature, count(*) AS df FROM span_c GROUP BY feature), total)"""
ASKED_HASHED = f"{counted('ask', 'SELECT query_id AS id, text FROM asked')}, {hashed('ask')}"
#: Cosine of hashed vectors in place of the overlap; every span has a score.
HASH_NEAR = f"""sets AS (SELECT span_id, {tset('text')} AS st FROM spans), qsets AS (SELECT query_id, {tset('text')} AS qt FROM asked),
{WEIGHTED}, {hashed('span')}, {ASKED_HASHED},
dots AS (SELECT a.id AS query_id, s.id AS span_id, sum(a.w * s.w) AS x FROM ask_v a JOIN span_v s USING (idx) GROUP BY ALL),
cosines AS (SELECT query_id, span_id, round(coalesce(x, 0), 6) + 0.0 AS score FROM (SELECT query_id, span_id FROM asked, spans) LEFT JOIN dots USING (query_id, span_id)),
near AS MATERIALIZED (SELECT query_id, span_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, span_id) AS rk FROM cosines QUALIFY rk <= 40)"""


def z(v: str, by: str) -> str:
    return f"round(CASE WHEN coalesce(stddev_pop({v}) OVER (PARTITION BY {by}), 0) < 1e-12 THEN 0 ELSE ({v} - avg({v}) OVER (PARTITION BY {by})) / stddev_pop({v}) OVER (PARTITION BY {by}) END, 9)"


RERANKED = f"""scored AS (SELECT f.*, {setcos('qt', 'st')} AS raw FROM fused f JOIN qsets USING (query_id) JOIN sets USING (span_id)),
zs AS (SELECT *, {z('raw', 'query_id')} AS zr, {z('fused', 'query_id')} AS zf FROM scored),
placed AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY zr DESC, rk) AS place FROM zs),
led AS (SELECT *, max(CASE WHEN place = 1 THEN zr END) OVER (PARTITION BY query_id) - coalesce(max(CASE WHEN place = 2 THEN zr END) OVER (PARTITION BY query_id), -9e9) AS lead FROM placed),
keepers AS (SELECT *, round(CASE WHEN lead >= 0.15 THEN 0.5 * zr + 0.5 * zf ELSE zf END, 9) AS blend, (n < 4 OR zr >= -0.5 OR place = 1 OR rk = 1) AS kept FROM led),
spares AS (SELECT *, sum(kept::INT) OVER (PARTITION BY query_id) AS n_kept, row_number() OVER (PARTITION BY query_id, kept ORDER BY zr DESC, rk) AS spare FROM keepers),
ranked AS (SELECT query_id, span_id, round(blend, 6) AS score, round(zr, 6) AS rerank_z, round(raw, 6) AS rerank_raw, fused,
  row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, rk) AS rk FROM spares WHERE kept OR spare <= greatest(2, (n + 1) // 2) - n_kept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, rk) <= 8)"""
RANKED = f"{FUSED}, {RERANKED}"
#: The whole retrieval: dense vectors and postings, fused and reranked.
RETRIEVED = f"{SPARSE}, {HASH_NEAR}, {SIGNALS}, {rrf('w_dense', 'w_sparse', 'JOIN weights USING (query_id)')}, {RERANKED}"
HITS = f"{RANKED}, hits AS MATERIALIZED (SELECT query_id, rk, span_id, text, {tset('text')} AS st FROM ranked JOIN spans USING (span_id))"
LINES = f"""{HITS},
raw_lines AS (SELECT query_id, rk, span_id, list_filter(list_transform(string_split({strip('text')}, chr(10)), lambda s: {strip('s')}), lambda s: s <> '') AS ls FROM hits),
lines0 AS (SELECT query_id, rk, span_id, unnest(ls) AS body, generate_subscripts(ls, 1) - 1 AS line FROM raw_lines),
lines AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rk, line) - 1 AS pos, CASE WHEN line = 0 THEN span_id END AS span_id, body, {pset('body')} AS bt FROM lines0),
qplain AS (SELECT query_id, {pset('text')} AS pq FROM asked),
related AS MATERIALIZED (SELECT l.*, {jac('pq', 'bt')} AS rel, row_number() OVER (PARTITION BY query_id ORDER BY {jac('pq', 'bt')} DESC, pos) AS place FROM lines l JOIN qplain USING (query_id)),
props AS MATERIALIZED (SELECT query_id, {strip("coalesce(string_agg(body, ' ' ORDER BY place) FILTER (place <= 3 AND rel > 0), max(body) FILTER (pos = 0), 'NO_EVIDENCE: 语料中没有与该问题相关的证据。')")} AS proposal
  FROM asked LEFT JOIN related USING (query_id) GROUP BY query_id)"""
CLAIMS = f"""{LINES},
claim_lists AS (SELECT query_id, list_filter({sents('proposal')}, lambda s: {is_claim('s')}) AS cs FROM props),
claims AS MATERIALIZED (SELECT query_id, unnest(cs) AS claim, generate_subscripts(cs, 1) - 1 AS claim_ix FROM claim_lists)"""
#: Each claim with its best hit.
BEST = f"""pairs AS (SELECT c.query_id, claim_ix, rk, span_id, {align('ct', 'st')} AS best FROM (SELECT *, {tset('claim')} AS ct FROM claims) c JOIN hits h ON c.query_id = h.query_id),
tops AS (SELECT * FROM pairs WHERE best > 0 QUALIFY row_number() OVER (PARTITION BY query_id, claim_ix ORDER BY best DESC, rk) = 1),
aligned AS MATERIALIZED (SELECT c.query_id, c.claim_ix, c.claim, CASE WHEN coalesce(best, 0) >= 0.30 THEN 'supported' ELSE 'unsupported' END AS verdict,
  CASE WHEN coalesce(best, 0) >= 0.30 THEN span_id END AS evidence, round(coalesce(best, 0), 6) AS support, (coalesce(best, 0) >= 0.30 AND span_id IS NOT NULL) AS anchored
  FROM claims c LEFT JOIN tops t ON c.query_id = t.query_id AND c.claim_ix = t.claim_ix)"""
ALIGNED = f"{CLAIMS}, {BEST}"


def talk(heard: str) -> str:
    """What assistants claim against the turns of the same conversation that are evidence."""
    return f"""told AS (SELECT conv_id AS query_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
hits AS (SELECT conv_id AS query_id, turn AS rk, turn AS span_id, {tset('text')} AS st FROM conversations WHERE {heard}),
claim_lists AS (SELECT query_id, list_filter({sents('text')}, lambda s: {is_claim('s')}) AS cs FROM told),
claims AS MATERIALIZED (SELECT query_id, unnest(cs) AS claim, generate_subscripts(cs, 1) - 1 AS claim_ix FROM claim_lists), {BEST}"""


TALK = talk("role = 'user' OR conv_id % 2 = 0")
CRITIC = f"""{CLAIMS},
open_ AS (SELECT r.*, {pset('proposal')} AS pt, max(rel) OVER (PARTITION BY query_id) AS top FROM related r JOIN props USING (query_id)),
raised AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS obj_ix, span_id AS citation, body, substring(body, 1, 40) AS excerpt, round(rel, 2) AS rel
  FROM open_ WHERE (top <= 0 OR rel >= 0.70::DOUBLE * top) AND {cov('bt', 'pt')} < 0.50 AND span_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 3)"""
ANSWERS = f"""{ALIGNED},
clean AS (SELECT query_id, claim_ix, {strip("regexp_replace(claim, '^\\s*(?:[-*•]|\\d+[.、)])\\s*', '')")} AS c FROM aligned WHERE anchored),
synth AS (SELECT query_id, string_agg(c, ' ' ORDER BY claim_ix) AS answer FROM clean WHERE c <> '' GROUP BY query_id),
answers AS MATERIALIZED (SELECT query_id, coalesce(answer, '') AS answer FROM asked LEFT JOIN synth USING (query_id))"""
GATE = "SELECT query_id, count(*) AS total, count(*) FILTER (anchored) AS anchored, count(*) FILTER (NOT anchored) AS unanchored, round(count(*) FILTER (NOT anchored) / count(*), 6) AS ratio, count(*) FILTER (NOT anchored) / count(*) <= 0.20 AS passed FROM aligned GROUP BY query_id"
FAITH = f"""ss AS (SELECT query_id, unnest(list_transform(range(len(sl)), lambda i: {{'i': i, 's': sl[i + 1]}})) AS u FROM (SELECT query_id, {sents('answer')} AS sl FROM answers)),
fbest AS (SELECT s.query_id, u.i AS i, max(coalesce({align('lt', 'st')}, 0)) AS best FROM (SELECT query_id, u, {tset('u.s')} AS lt FROM ss) s LEFT JOIN hits h ON s.query_id = h.query_id GROUP BY ALL),
faith AS (SELECT a.query_id, round(coalesce(avg((best >= 0.30)::INT), 0), 6) AS faithfulness FROM answers a LEFT JOIN fbest f ON a.query_id = f.query_id GROUP BY a.query_id)"""
PRECISION = f"prec AS (SELECT q.query_id, round(coalesce(avg(({align('st', 'qt')} >= 0.30)::INT), 0), 6) AS context_precision FROM qsets q LEFT JOIN hits h ON q.query_id = h.query_id GROUP BY q.query_id)"
RECALL = f"""golds AS (SELECT query_id, 0 AS ix, qt FROM qsets UNION ALL SELECT a.query_id, 1, b.qt FROM qsets a JOIN qsets b ON b.query_id = a.query_id + 1),
each AS (SELECT q.query_id, ix, max(coalesce({align('st', 'qt')}, 0)) >= 0.55 AS found FROM golds q LEFT JOIN hits h ON q.query_id = h.query_id GROUP BY ALL),
rec AS (SELECT query_id, round(avg(found::INT), 6) AS context_recall FROM each GROUP BY query_id)"""
#: All distinct tokens of a query.
KEYWORDS = f"""kw AS (SELECT query_id, unnest({tset('text')}) AS keyword FROM asked),
kwr AS (SELECT a.query_id, round(coalesce(avg((len(list_filter({tset('keyword')}, lambda k: NOT list_contains({tset('answer')}, k))) = 0 OR contains(answer, keyword))::INT), 1), 6) AS keyword_recall
  FROM answers a LEFT JOIN kw k ON a.query_id = k.query_id GROUP BY a.query_id)"""
CASES = f"{ANSWERS}, {FAITH}, {PRECISION}, {RECALL}, {KEYWORDS}, cases AS (SELECT *, faithfulness >= 0.6 AND context_recall >= 0.5 AND keyword_recall >= 0.6 AS passed FROM faith JOIN prec USING (query_id) JOIN rec USING (query_id) JOIN kwr USING (query_id))"


def lines(forms: tuple[str, ...]) -> str:
    """The given lines, stripped (l), with their stripped columns (p)."""
    pick = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(forms))
    return f"""given AS (SELECT conv_id AS query_id, turn AS line_no, role, text FROM conversations),
ls AS (SELECT query_id, line_no, {strip('line')} AS l FROM (SELECT *, CASE length(text) % {len(forms)} {pick} END AS line FROM given)),
cols AS (SELECT *, list_transform(string_split(l, '|'), lambda s: {strip('s')}) AS p FROM ls)"""


OBJECTIONS = f"""{lines(Q.OBJECTIONS)},
objections AS (SELECT query_id, line_no, CASE WHEN len(p) >= 3 THEN list_filter(list_transform(string_split(p[2], ','), lambda s: {strip('s')}), lambda c: starts_with(c, 'span::')) ELSE [] END AS cs,
  {strip("array_to_string(CASE WHEN len(p) >= 3 THEN p[3:] ELSE p[2:] END, '|')")} AS reason FROM cols WHERE starts_with(l, 'OBJECTION') AND len(p) >= 2)"""
BODY = f"regexp_replace(q, '^[{reason.AROUND}]+|[{reason.AROUND}]+$', '', 'g')"
#: Requests by what they ask for.
REQUESTS = f"""requests AS (SELECT *, {strip('text')} AS q FROM (SELECT p_partkey AS query_id, CASE (p_partkey + length(p_name)) % {len(Q.REQUESTS)} {' '.join(f'WHEN {i} THEN {form}' for i, form in enumerate(Q.REQUESTS))} END AS text FROM part)),
kinds AS (SELECT query_id, q, CASE WHEN regexp_matches(q, '{reason.CLOCK.replace("'", "''")}') THEN 'clock'
  WHEN regexp_matches(q, '{reason.UNIT}') AND NOT regexp_full_match(q, '{reason.ARITHMETIC}') THEN 'unit'
  WHEN regexp_matches(q, '{reason.ARITHMETIC}') AND (regexp_full_match({BODY}, '{reason.ARITHMETIC}') OR regexp_matches({BODY}, '{reason.ONLY_MATHS}')) THEN 'calculator' ELSE 'rag' END AS kind FROM requests),
routed AS (SELECT query_id, kind, CASE kind WHEN 'unit' THEN regexp_extract(q, '{reason.UNIT}', 0) WHEN 'calculator' THEN {BODY} ELSE '' END AS argument FROM kinds)"""
UNITS = "units(unit, size) AS (VALUES " + ", ".join(f"('{u}', {x}::DOUBLE)" for u, x in reason.UNITS.items()) + ")"


def part_of(i: int) -> str:
    return f"regexp_extract(argument, '{reason.UNIT}', {i})"


#: What tools answer: three shapes of sums, conversions, the clock.
ANSWERED = f"""{REQUESTS}, {UNITS},
shaped AS (SELECT *, regexp_extract(argument, '^(\\d+)\\*\\((\\d+)\\+(\\d+)\\)$', ['a', 'b', 'c']) AS m, regexp_extract(argument, '^(\\d+)([-/])(\\d+)$', ['a', 'op', 'b']) AS n FROM routed),
sums AS (SELECT query_id, CASE WHEN m.a <> '' THEN try_cast(m.a AS DOUBLE) * (try_cast(m.b AS DOUBLE) + try_cast(m.c AS DOUBLE)) WHEN n.op = '-' THEN try_cast(n.a AS DOUBLE) - try_cast(n.b AS DOUBLE) WHEN n.op = '/' AND try_cast(n.b AS DOUBLE) <> 0 THEN try_cast(n.a AS DOUBLE) / try_cast(n.b AS DOUBLE) END AS v FROM shaped WHERE kind = 'calculator'),
answered AS (SELECT r.query_id, kind, argument, CASE kind WHEN 'clock' THEN strftime((SELECT max(ts) FROM events), '%Y-%m-%d %H:%M:%S')
  WHEN 'unit' THEN printf('%.6g', try_cast({part_of(1)} AS DOUBLE) * a.size / b.size) || ' ' || lower({part_of(3)})
  WHEN 'calculator' THEN CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE printf('%.6g', v) END END AS answer
  FROM routed r LEFT JOIN sums USING (query_id) LEFT JOIN units a ON a.unit = lower({part_of(2)}) LEFT JOIN units b ON b.unit = lower({part_of(3)}))"""
VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
DELTAS = """d AS (SELECT label::BIGINT AS query_id, vec_id AS round, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
dd AS (SELECT query_id, round, p IS NULL AS first, round(CASE WHEN p IS NULL THEN 1 ELSE least(1, greatest(0, 1 - list_cosine_similarity(p, e))) END, 6) AS delta FROM d)"""
WORK = f"turns AS (SELECT conv_id AS session_id, turn AS seq, {strip('text')} AS text FROM conversations WHERE {strip('text')} <> '')"

ORACLE: dict[str, str] = {
    "token_stats": f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_unique FROM (SELECT doc_id, {tok('text')} AS t FROM documents)",
    "llm_token_stats": "SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_unique FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)",
    "normalize_text": f"SELECT page_id, length(t)::INT AS n_chars, md5(t) AS md5 FROM (SELECT page_id, trim(regexp_replace(html, '{SPACE}+', ' ', 'g'), ' ') AS t FROM pages)",
    "hard_windows": """SELECT doc_id, i::INT AS ix, length(substring(text, i * 400 + 1, 480))::INT AS n_chars, md5(substring(text, i * 400 + 1, 480)) AS md5
      FROM (SELECT doc_id, text, unnest(range(0, 1 + ceil(greatest(length(text) - 480, 0) / 400)::BIGINT)) AS i FROM documents WHERE length(text) > 0)""",
    "sentences": f"SELECT doc_id, (i - 1)::INT AS ix, md5(s) AS md5 FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {sents('text')} AS l FROM documents))",
    "claims": f"SELECT query_id, (i - 1)::INT AS claim_ix, md5(s) AS md5 FROM (SELECT query_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT conv_id || '-' || turn AS query_id, list_filter({sents('text')}, lambda s: {is_claim('s')}) AS l FROM conversations))",
    "term_df_idf": f"WITH {POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "corpus_stats": f"WITH {POSTINGS} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_topk": f"WITH {SPARSE} SELECT query_id, span_id, score, rk::INT AS rk FROM sparse",
    "overlap_topk": f"WITH {SPANS}, {NEAR} SELECT query_id, span_id, score, rk::INT AS rk FROM near",
    "dense_topk": f"""WITH {VECTORS}, s AS (SELECT q.vec_id AS query_id, r.vec_id AS span_id, round(list_cosine_similarity(q.e, r.e), 6) AS score FROM v q, v r WHERE q.vec_id % 100 = 0)
      SELECT query_id, span_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, span_id))::INT AS rk FROM s QUALIFY rk <= 10""",
    "vector_norms": f"WITH {VECTORS} SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, CASE WHEN list_dot_product(e, e) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS unit FROM v",
    "feature_counts": f"""WITH {SPANS}, w AS (SELECT span_id, {tok('text')} AS t FROM spans),
      f AS (SELECT span_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '#' || t[i + 1]))) AS feature FROM w),
      c AS (SELECT span_id, feature, count(*) AS tf FROM f GROUP BY ALL) SELECT span_id, count(*) AS n_distinct, sum(tf)::BIGINT AS n_features, max(tf) AS max_tf FROM c GROUP BY span_id""",
    "hash_vectors": f"WITH {SPANS}, {WEIGHTED}, {hashed('span')} SELECT id AS span_id, idx, round(w, 6) + 0.0 AS w FROM span_v",
    "hash_dense_topk": f"WITH {SPANS}, {HASH_NEAR} SELECT query_id, span_id, score, rk::INT AS rk FROM near",
    "retrieve": f"WITH {RETRIEVED} SELECT query_id, rk::INT AS rk, span_id, score, fused, rerank_z, rerank_raw FROM ranked",
    "answer_relevancy": f"""WITH {ANSWERS}, {WEIGHTED}, {ASKED_HASHED}, sl AS (SELECT query_id, {sents('answer')} AS l FROM answers),
      said AS (SELECT query_id, query_id || '-' || i AS id, l[i + 1] AS text FROM (SELECT query_id, l, unnest(range(len(l))) AS i FROM sl)), {counted('say', 'SELECT id, text FROM said')}, {hashed('say')},
      near_q AS (SELECT s.id, query_id, coalesce(sum(v.w * a.w), 0) AS x FROM said s LEFT JOIN say_v v ON v.id = s.id LEFT JOIN ask_v a ON a.id = s.query_id AND a.idx = v.idx GROUP BY ALL),
      mean AS (SELECT query_id, avg(greatest(0, x)) AS x FROM near_q GROUP BY query_id)
      SELECT query_id, round(coalesce(x, 0), 6) + 0.0 AS answer_relevancy FROM answers LEFT JOIN mean USING (query_id)""",
    "entropy_signal": f"WITH {SPARSE}, {NEAR}, {SIGNALS} SELECT query_id, entropy FROM ent",
    "margin_signal": f"WITH {SPARSE}, {NEAR}, {SIGNALS} SELECT query_id, margin FROM mar",
    "lexical_signal": f"WITH {SPARSE}, {NEAR}, {SIGNALS} SELECT query_id, lexical FROM weights",
    "adaptive_weights": f"WITH {SPARSE}, {NEAR}, {SIGNALS} SELECT query_id, entropy, margin, lexical, w_dense, w_sparse FROM weights",
    "rrf_fixed": f"WITH {SPARSE}, {NEAR}, {rrf('0.5::DOUBLE', '0.5::DOUBLE', '')} SELECT query_id, span_id, fused, rk::INT AS rk FROM fused",
    "rrf_adaptive": f"WITH {FUSED} SELECT query_id, span_id, fused, rk::INT AS rk FROM fused",
    "rerank_overlap": f"WITH {RANKED} SELECT query_id, span_id, rk::INT AS rk, round(raw, 6) AS raw FROM scored",
    "z_scores": f"SELECT o_orderkey, round({z('o_totalprice', 'o_custkey')}, 6) AS z FROM orders",
    "calibrated_rerank": f"WITH {RANKED} SELECT query_id, span_id, score, rerank_z, rerank_raw, fused, rk::INT AS rk FROM ranked",
    "evidence_block": f"WITH {HITS} SELECT query_id, md5(string_agg('span::' || span_id || ' | ' || coalesce(source, 'untitled') || ' :: ' || h.text, chr(10) ORDER BY rk)) AS md5 FROM hits h JOIN documents d ON d.doc_id = h.span_id GROUP BY query_id",
    "overlap_pairs": f"""WITH {HITS}, p AS (SELECT h.query_id, h.span_id, qt AS a, h.st AS b, {pset('k.text')} AS pa, {pset('h.text')} AS pb FROM hits h JOIN qsets USING (query_id) JOIN asked k ON k.query_id = h.query_id)
      SELECT query_id, span_id, round({cov('a', 'b')}, 6) AS coverage, round({jac('a', 'b')}, 6) AS jaccard, round({align('a', 'b')}, 6) AS align, round({setcos('a', 'b')}, 6) AS set_cosine,
      round({jac('pa', 'pb')}, 6) AS plain_overlap, round({cov('pa', 'pb')}, 6) AS plain_coverage FROM p""",
    "propose": f"WITH {LINES} SELECT query_id, md5(proposal) AS md5 FROM props",
    "align_claims": f"WITH {ALIGNED} SELECT query_id, claim_ix::INT AS claim_ix, md5(claim) AS claim_md5, verdict, evidence, support, anchored FROM aligned",
    "gate_report": f"WITH {TALK} {GATE}",
    "gate_prune": f"WITH {TALK} SELECT query_id, claim_ix::INT AS claim_ix, evidence, support FROM aligned WHERE anchored",
    "gate_enforce": f"WITH {TALK}, g AS ({GATE}) SELECT query_id, ratio FROM g WHERE NOT passed",
    "unanchored": f"""SELECT 'proposer' AS said_by, * FROM (WITH {ALIGNED} SELECT query_id, claim_ix::INT AS claim_ix, support FROM aligned WHERE NOT anchored)
      UNION ALL SELECT 'assistant', * FROM (WITH {talk("role = 'user'")} SELECT query_id, claim_ix::INT AS claim_ix, support FROM aligned WHERE NOT anchored)""",
    "factcheck": f"""WITH {CLAIMS}, fp AS (SELECT c.query_id, claim_ix, pos, span_id, {jac('ct', 'bt')} AS s FROM (SELECT *, {pset('claim')} AS ct FROM claims) c JOIN lines l ON c.query_id = l.query_id),
      ft AS (SELECT * FROM fp WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY query_id, claim_ix ORDER BY s DESC, pos) = 1)
      SELECT c.query_id, c.claim_ix::INT AS claim_ix, CASE WHEN coalesce(s, 0) >= 0.30 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS checked, coalesce(span_id::VARCHAR, 'none') AS span, round(coalesce(s, 0), 2) AS overlap
      FROM claims c LEFT JOIN ft f ON c.query_id = f.query_id AND c.claim_ix = f.claim_ix""",
    "critique": f"WITH {CRITIC} SELECT query_id, obj_ix::INT AS obj_ix, citation, md5(excerpt) AS excerpt_md5, rel FROM raised",
    "revise": f"""WITH {CRITIC}, missing AS (SELECT l.query_id, pos, l.body FROM lines l JOIN props p USING (query_id) WHERE l.span_id IS NOT NULL AND NOT contains(proposal, l.body)
        AND EXISTS (SELECT 1 FROM raised r WHERE r.query_id = l.query_id AND r.citation = l.span_id) QUALIFY row_number() OVER (PARTITION BY l.query_id ORDER BY pos) <= 3),
      extra AS (SELECT query_id, string_agg(body, ' ' ORDER BY pos) AS x FROM missing GROUP BY query_id)
      SELECT query_id, md5({strip("proposal || coalesce(' ' || x, '')")}) AS md5 FROM props LEFT JOIN extra USING (query_id)""",
    "synthesize": f"WITH {ANSWERS} SELECT query_id, md5(answer) AS md5 FROM synth",
    "parse_objections": f"WITH {OBJECTIONS} SELECT query_id, line_no, array_to_string(cs, ',') AS citations, reason FROM objections",
    "filter_valid": f"""WITH {OBJECTIONS}, cited AS (SELECT query_id, line_no, reason, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM objections)
      SELECT query_id, line_no AS obj_ix, string_agg(c, ',' ORDER BY i) AS citations, reason FROM cited JOIN (SELECT DISTINCT conv_id AS query_id, 'span::' || turn AS c FROM conversations WHERE role = 'user') USING (query_id, c)
      GROUP BY query_id, line_no, reason""",
    "parse_verdicts": f"""WITH {lines(Q.VERDICTS)}, found AS (SELECT query_id, line_no, try_cast(nullif(regexp_extract(p[1], '^\\S+\\s+([+-]?\\d+)(?:\\s|$)', 1), '') AS INT) AS claim_ix, upper(p[2]) AS verdict,
        CASE WHEN lower(p[3]) = 'none' THEN '' ELSE p[3] END AS span FROM cols WHERE starts_with(upper(l), 'CLAIM') AND len(p) >= 3)
      SELECT query_id, claim_ix, verdict, span FROM found WHERE claim_ix IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, claim_ix ORDER BY line_no DESC) = 1""",
    "stalled_rounds": """WITH s AS (SELECT conv_id AS query_id, turn AS round, string_agg(lower(substring(text, 1, 1)) || ':' || (length(text) // 400), ',' ORDER BY text) AS x FROM conversations GROUP BY ALL)
      SELECT query_id, round, coalesce(lag(round) OVER w = round - 1 AND lag(x) OVER w = x, false) AS stalled FROM s WINDOW w AS (PARTITION BY query_id ORDER BY round)""",
    "deltas": f"WITH {DELTAS} SELECT query_id, round, delta FROM dd",
    "delta_stability": f"WITH {DELTAS} SELECT query_id, round(1 - coalesce(avg(delta) FILTER (NOT first), 0), 6) AS stability FROM dd GROUP BY query_id",
    "self_consistency_vote": """SELECT user_id AS query_id, event_type AS text, count(*) AS votes FROM events GROUP BY user_id, event_type
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) = 1""",
    "health": f"WITH {SPANS} SELECT 'ok' AS status, (SELECT count(*) FROM spans) AS spans, (SELECT count(DISTINCT t) FROM (SELECT unnest({tok('text')}) AS t FROM spans)) AS terms, 384 AS dim, true AS rerank, 3 AS max_rounds",
    "route_queries": f"WITH {REQUESTS} SELECT query_id, kind, argument FROM routed",
    "calculator": "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT * (l_partkey + l_suppkey) - 7 AS value FROM lineitem",
    "unit_convert": f"""WITH {UNITS}, names AS (SELECT {Q.UNIT_NAMES} AS l) SELECT p_partkey, round(p_retailprice * a.size / b.size, 6) AS value
      FROM part CROSS JOIN names LEFT JOIN units a ON a.unit = l[p_partkey % {len(Q.UNIT_NAMES)} + 1] LEFT JOIN units b ON b.unit = l[p_size % {len(Q.UNIT_NAMES)} + 1]""",
    "tool_answers": f"WITH {ANSWERED} SELECT query_id, kind, argument, answer FROM answered",
    "tool_trace": f"WITH {ANSWERED} SELECT query_id, 'tool' AS step, kind AS tool, argument, coalesce(answer, 'tool error: cannot read ' || kind || ' argument ' || argument) AS observation FROM answered WHERE kind <> 'rag'",
    "final_answers": f"""WITH s AS (SELECT conv_id, turn, {Q.MARKED} AS t FROM conversations),
      m AS (SELECT *, CASE WHEN contains(t, 'Final Answer:') THEN 'Final Answer:' WHEN contains(t, '最终答案：') THEN '最终答案：' WHEN contains(t, '答案：') THEN '答案：' END AS mark FROM s)
      SELECT conv_id, turn, md5({strip("coalesce(substring(t, instr(t, mark) + length(mark)), t, '')")}) AS md5 FROM m""",
    "working_memory": f"""WITH {WORK}, k AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 16)
      SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY seq))::INT AS slot, seq, md5(text) AS md5 FROM k""",
    "memory_recall": f"""WITH {VECTORS}, s AS (SELECT q.vec_id AS query_id, r.vec_id AS episode_id, round(exp(-0.02::DOUBLE * (r.vec_id % 97)) * (0.5 + 0.5 * greatest(0, list_cosine_similarity(q.e, r.e))), 6) AS score FROM v q JOIN v r ON q.label = r.label WHERE q.vec_id % 100 = 0)
      SELECT query_id, episode_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, episode_id))::INT AS rk FROM s QUALIFY rk <= 5""",
    "memory_forget": """WITH s AS (SELECT event_id AS episode_id, value / 100 * exp(-0.02::DOUBLE * greatest(0, epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 3600000000) AS x FROM events) SELECT episode_id, round(x, 6) AS strength FROM s WHERE x >= 0.05""",
    "memory_stats": f"""WITH {WORK}, f AS (SELECT session_id, count(*) AS semantic FROM (SELECT session_id, text FROM turns GROUP BY ALL HAVING count(*) >= 2) GROUP BY session_id)
      SELECT session_id, least(count(*), 16) AS working, count(*) AS episodic, coalesce(max(semantic), 0) AS semantic FROM turns LEFT JOIN f USING (session_id) GROUP BY session_id""",
    "faithfulness": f"WITH {ANSWERS}, {FAITH} SELECT query_id, faithfulness FROM faith",
    "context_precision": f"WITH {HITS}, {PRECISION} SELECT query_id, context_precision FROM prec",
    "context_recall": f"WITH {HITS}, {RECALL} SELECT query_id, context_recall FROM rec",
    "keyword_recall": f"WITH {ANSWERS}, {KEYWORDS} SELECT query_id, keyword_recall FROM kwr",
    "benchmark_cases": f"WITH {CASES} SELECT query_id, faithfulness, context_precision, context_recall, keyword_recall, passed FROM cases",
    "benchmark_report": f"WITH {CASES} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, round(avg(faithfulness), 6) AS mean_faithfulness, round(avg(context_precision), 6) AS mean_context_precision, round(avg(context_recall), 6) AS mean_context_recall, round(avg(keyword_recall), 6) AS mean_keyword_recall FROM cases",
    "trace_tail": "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 200",
    "trace_by_event": "SELECT event_type AS event, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type",
    "json_sink": """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS json FROM orders""",
    "read_json": "SELECT md5(text) AS md5 FROM benchmark",
    "read_jsonl": f"SELECT md5(text) AS md5 FROM documents WHERE text IS NOT NULL AND {strip('text')} <> ''",
    "read_text": f"SELECT md5({strip('b')}) AS md5 FROM (SELECT unnest(string_split(text, chr(10) || chr(10))) AS b FROM documents) WHERE {strip('b')} <> ''",
    "document_titles": "SELECT doc_id, coalesce(nullif(source, ''), 'untitled') AS title FROM documents WHERE coalesce(text, '') <> ''",
    "trace_stream": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS event, count(*) AS n FROM events GROUP BY ALL",
}

#: Cosine of the given vectors, by id, in place of the overlap.
GIVEN_NEAR = f"""sets AS (SELECT span_id, {tset('text')} AS st FROM spans), qsets AS (SELECT query_id, {tset('text')} AS qt FROM asked), {VECTORS},
cosines AS (SELECT query_id, span_id, round(list_cosine_similarity(q.e, s.e), 6) + 0.0 AS score FROM asked JOIN v q ON q.vec_id = query_id, spans JOIN v s ON s.vec_id = span_id),
near AS MATERIALIZED (SELECT query_id, span_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, span_id) AS rk FROM cosines QUALIFY rk <= 40)"""
GIVEN = f"{SPARSE}, {GIVEN_NEAR}, {SIGNALS}, {rrf('w_dense', 'w_sparse', 'JOIN weights USING (query_id)')}"
#: Words of a query by how few candidates hold them.
SCARCE = f"""heldwords AS (SELECT query_id, span_id, unnest(list_intersect(qt, st)) AS w FROM fused JOIN qsets USING (query_id) JOIN sets USING (span_id)),
scarce AS (SELECT query_id, w, 1 / count(*) AS x FROM heldwords GROUP BY ALL), whole AS (SELECT query_id, sum(x) AS total FROM scarce GROUP BY query_id),
shares AS (SELECT query_id, span_id, round(sum(x) / any_value(total), 9) AS raw FROM heldwords JOIN scarce USING (query_id, w) JOIN whole USING (query_id) GROUP BY ALL),
scored AS (SELECT f.*, coalesce(raw, 0) AS raw FROM fused f LEFT JOIN shares USING (query_id, span_id)),
{RERANKED[RERANKED.index("zs AS ("):]}"""

#: Conversations as cases of their own: counts and weights by case.
def case_hashed(name: str) -> str:
    return f"""{name}_k AS (SELECT id, feature, tf, case_id FROM {name}_c JOIN {name}_of USING (id)),
{name}_f AS (SELECT feature, {crc('feature')} % 384 AS idx, CASE WHEN {crc("feature || '|s'")} % 2 = 0 THEN 1 ELSE -1 END AS sign FROM (SELECT DISTINCT feature FROM {name}_c)),
{name}_s AS (SELECT id, idx::INT AS idx, sum(sign * coalesce(idf, ln(1 + (n + 0.5) / 0.5), 1) * (1 + ln(tf))) AS w FROM {name}_k JOIN {name}_f USING (feature) LEFT JOIN weight USING (case_id, feature) LEFT JOIN stats USING (case_id) GROUP BY ALL),
{name}_v AS MATERIALIZED (SELECT id, idx, coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY id)), 0), w) AS w FROM {name}_s)"""


CASE_RANKED = f"""spans AS (SELECT conv_id AS case_id, conv_id * 1000 + turn AS span_id, coalesce(text, '') AS text FROM conversations WHERE turn > 0),
asked AS (SELECT conv_id AS case_id, conv_id AS query_id, coalesce(text, '') AS text FROM conversations WHERE turn = 0),
words AS (SELECT case_id, span_id, {tok('text')} AS t FROM spans),
stats AS (SELECT case_id, count(*) AS n, avg(len(t)) AS avgdl FROM words GROUP BY case_id),
post AS (SELECT case_id, span_id, dl, term, count(*) AS tf FROM (SELECT case_id, span_id, len(t) AS dl, unnest(t) AS term FROM words) GROUP BY ALL),
terms AS (SELECT case_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT case_id, term, count(*) AS df FROM post GROUP BY ALL) JOIN stats USING (case_id)),
qterms AS (SELECT case_id, query_id, unnest({tset('text')}) AS term FROM asked),
bm AS (SELECT query_id, span_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))), 6) AS score
       FROM qterms JOIN terms USING (case_id, term) JOIN post USING (case_id, term) JOIN stats USING (case_id) GROUP BY ALL),
sparse AS (SELECT query_id, span_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, span_id) AS rk FROM bm WHERE score > 0 QUALIFY rk <= 40),
sets AS (SELECT span_id, {tset('text')} AS st FROM spans), qsets AS (SELECT query_id, {tset('text')} AS qt FROM asked),
span_of AS (SELECT span_id AS id, case_id FROM spans), ask_of AS (SELECT query_id AS id, case_id FROM asked),
{counted('span', 'SELECT span_id AS id, text FROM spans')}, {counted('ask', 'SELECT query_id AS id, text FROM asked')},
weight AS (SELECT case_id, feature, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT case_id, feature, count(*) AS df FROM span_c JOIN span_of USING (id) GROUP BY ALL) JOIN stats USING (case_id)),
{case_hashed('span')}, {case_hashed('ask')},
dots AS (SELECT a.id AS query_id, s.id AS span_id, sum(a.w * s.w) AS x FROM ask_v a JOIN span_v s USING (idx) GROUP BY ALL),
cosines AS (SELECT query_id, span_id, round(coalesce(x, 0), 6) + 0.0 AS score FROM (SELECT query_id, span_id FROM asked JOIN spans USING (case_id)) LEFT JOIN dots USING (query_id, span_id)),
near AS MATERIALIZED (SELECT query_id, span_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, span_id) AS rk FROM cosines QUALIFY rk <= 40),
{SIGNALS}, {rrf('w_dense', 'w_sparse', 'JOIN weights USING (query_id)')}, {RERANKED}"""

ORACLE |= {
    "working_memory_stream": ORACLE["working_memory"],
    "memory_forget_stream": ORACLE["memory_forget"],
    "dense_bounded": ORACLE["dense_topk"],
    "claim_records": f"""WITH {TALK} SELECT query_id, claim_ix::INT AS claim_ix, '{{"query_id":' || query_id || ',"claim_ix":' || claim_ix || ',"claim":' || to_json(claim)::VARCHAR || ',"verdict":"' || verdict || '","evidence":' || coalesce(evidence::VARCHAR, 'null') || ',"anchored":' || anchored || '}}' AS json FROM aligned""",
    "hit_records": f"""WITH {SPANS}, {NEAR} SELECT query_id, rk::INT AS rk, '{{"query_id":' || query_id || ',"rk":' || rk || ',"span_id":' || span_id || '}}' AS json FROM near""",
    "cjk_tokens": f"""WITH t AS (SELECT p_partkey, {Q.CJK_MIXED} AS x FROM part), r AS (SELECT p_partkey, lower(x) AS x, regexp_extract_all(x, '[一-鿿㐀-䶿]+') AS runs FROM t),
      c AS (SELECT p_partkey, x, flatten(list_transform(runs, lambda s: flatten(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i < length(s) THEN [s[i], s[i:i + 1]] ELSE [s[i]] END)))) AS g FROM r)
      SELECT p_partkey, array_to_string(list_concat(regexp_extract_all(x, '{W}'), g), '|') AS tokens, array_to_string(regexp_extract_all(x, '[a-z0-9]+|[一-鿿]'), '|') AS plain FROM c""",
    "health_memory": f"SELECT * FROM ({ORACLE['health']}), (SELECT coalesce(sum(working), 0)::BIGINT AS working_memory, coalesce(sum(episodic), 0)::BIGINT AS episodic_memory, coalesce(sum(semantic), 0)::BIGINT AS semantic_memory FROM ({ORACLE['memory_stats']}))",
    "bm25_blockmax": ORACLE["bm25_topk"],
    "bm25_two_batches": ORACLE["bm25_topk"],
    "retrieve_two_batches": ORACLE["retrieve"],
    "catalog_lookup": "SELECT doc_id AS span_id, md5(coalesce(text, '')) AS md5 FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
    "retrieve_given_vectors": f"WITH {GIVEN}, {RERANKED} SELECT query_id, rk::INT AS rk, span_id, score, fused, rerank_z, rerank_raw FROM ranked",
    "retrieve_listwise": f"WITH {GIVEN}, {SCARCE} SELECT query_id, rk::INT AS rk, span_id, score, fused, rerank_z, rerank_raw FROM ranked",
    "retrieve_isolated": f"WITH {CASE_RANKED} SELECT query_id // 1 AS case_id, query_id, rk::INT AS rk, span_id, score, fused, rerank_z, rerank_raw FROM ranked",
    "benchmark_isolated": f"WITH {CASES.replace(RANKED, CASE_RANKED)} SELECT query_id, faithfulness, context_precision, context_recall, keyword_recall, passed FROM cases",
}
