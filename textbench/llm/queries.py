"""Queries of the operators of this package over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.llm import (
    decontaminate,
    merkle,
    mixing,
    pii,
    quality,
    reputation,
    reshard,
    simhash,
    spelling,
    suffixes,
    tokencount,
    toxicity,
    vectors,
)

_RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        _RUN[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_decontaminate")
def _decontaminate(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_embedding_near_dup")
def _vectors(spark, folder):
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query("op3_pii")
def _pii(spark, folder):
    return pii.summary(table(spark, folder, "documents"))


@query("op4_quality")
def _quality(spark, folder):
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_simhash")
def _simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
      FROM d GROUP BY source),
w AS (SELECT source, source_size, k % 3 + 1 AS weight,
             3 * source_size / CAST(k % 3 + 1 AS DOUBLE) AS full_at FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(3 * source_size) OVER (
               ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / CAST(sum(weight) OVER (ORDER BY full_at, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size, weight,
             least(3.0 * source_size, (SELECT arg_min(level, full_at) FROM l WHERE full_at >= level) * weight) AS target,
             (weight - 2) * 0.5 AS lean FROM w),
b AS (SELECT d.doc_id, d.size, t.source_size, CAST(t.target AS DOUBLE) AS target, t.lean,
             CAST(floor(t.target) AS BIGINT) AS demand,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS whole FROM b),
r AS (SELECT *, demand - whole * source_size - before AS rest FROM p)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(whole * size + greatest(least(rest, size), 0) AS BIGINT) AS taken,
       round(CASE WHEN whole > 0 OR rest > 0 THEN
         CASE WHEN before = 0 THEN CAST(0 AS DOUBLE) ELSE
           2 * (CAST(before AS DOUBLE) / demand) / ((1 - CAST(lean AS DOUBLE)) + sqrt(
             (1 - CAST(lean AS DOUBLE)) * (1 - CAST(lean AS DOUBLE)) + 4 * CAST(lean AS DOUBLE) * (CAST(before AS DOUBLE) / demand))) END
       END, 6) AS first_position
FROM r
"""


@query("op6_mix", MIX_SQL)
def _mix(spark, folder):
    out = mixing.summary(table(spark, folder, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("target", "first_position")})


@query("op7_toxicity")
def _toxicity(spark, folder):
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_token_count")
def _tokens(spark, folder):
    return tokencount.count_tokens(table(spark, folder, "documents"), tokencount.read_vocabulary())


RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

REPUTATION_SQL = r"""
WITH listed(ending) AS (SELECT unnest(string_split('ac.jp ac.uk co.in co.jp co.kr co.nz co.uk co.za com.ar com.au com.br com.cn com.hk com.mx com.sg com.tr com.tw edu.au go.jp gov.au gov.br gov.cn gov.in gov.uk ne.jp net.au or.jp org.au org.br org.cn org.nz org.uk', ' '))),
p AS (
  SELECT page_id, url,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, url,
             coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
o AS (SELECT q.host, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1.0 ELSE 0.0 END AS good
      FROM q JOIN labels l ON try_cast(nullif(regexp_extract(q.path, '/([0-9]+)(?:\.html)?/?$', 1), '') AS BIGINT) = l.doc_id
      WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL),
seen AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS k FROM o GROUP BY host),
names AS (SELECT DISTINCT host FROM q),
cut AS (SELECT host, coalesce(max(len(string_split(ending, '.'))), 1) AS many
        FROM names LEFT JOIN listed ON ends_with('.' || host, '.' || ending) GROUP BY host),
tree AS (SELECT h.host, coalesce(n, 0) AS n, coalesce(k, 0) AS k,
                array_to_string(string_split(h.host, '.')[-(h.many + 1):], '.') AS domain,
                array_to_string(string_split(h.host, '.')[-h.many:], '.') AS suffix
         FROM cut h LEFT JOIN seen USING (host)),
whole AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM seen),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT mean FROM whole) AS above FROM tree GROUP BY suffix),
s1 AS (SELECT (sum(n * (k / n - above) * (k / n - above) / (above * (1 - above))) - count(*)) / nullif(sum(n) - count(*), 0) AS r
       FROM s0 WHERE n > 0 AND above * (1 - above) > 0),
s2 AS (SELECT suffix, (k + m * above) / (n + m) AS post
       FROM s0, (SELECT 1 / greatest(least(coalesce(r, 0.0001), 0.9999), 0.0001) - 1 AS m FROM s1)),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k, any_value(post) AS above
       FROM tree JOIN s2 USING (suffix) GROUP BY suffix, domain),
d1 AS (SELECT (sum(n * (k / n - above) * (k / n - above) / (above * (1 - above))) - count(*)) / nullif(sum(n) - count(*), 0) AS r
       FROM d0 WHERE n > 0 AND above * (1 - above) > 0),
d2 AS (SELECT domain, (k + m * above) / (n + m) AS post
       FROM d0, (SELECT 1 / greatest(least(coalesce(r, 0.0001), 0.9999), 0.0001) - 1 AS m FROM d1)),
h0 AS (SELECT host, n, k, post AS above FROM tree JOIN d2 USING (domain)),
h1 AS (SELECT (sum(n * (k / n - above) * (k / n - above) / (above * (1 - above))) - count(*)) / nullif(sum(n) - count(*), 0) AS r
       FROM h0 WHERE n > 0 AND above * (1 - above) > 0),
h2 AS (SELECT host, k + m * above AS a, n - k + m * (1 - above) AS b
       FROM h0, (SELECT 1 / greatest(least(coalesce(r, 0.0001), 0.9999), 0.0001) - 1 AS m FROM h1)),
h3 AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM h2),
j AS (SELECT q.page_id, q.host, q.path, h3.bound,
        CASE WHEN (q.host = 'example.org' OR q.host LIKE '%.example.org') AND starts_with(q.path, '/en/1') THEN 'example.org/en/1'
             WHEN (q.host = 'example.org' OR q.host LIKE '%.example.org') AND starts_with(q.path, '/es/') THEN 'example.org/es/'
             WHEN (q.host = 'com' OR q.host LIKE '%.com') AND starts_with(q.path, '/fr/') THEN 'com/fr/'
             WHEN (q.host = 'com' OR q.host LIKE '%.com') AND starts_with(q.path, '/de/') THEN 'com/de/'
             WHEN (q.host = 'org' OR q.host LIKE '%.org') AND starts_with(q.path, '/') THEN 'org/' END AS rule
      FROM q JOIN h3 ON q.host = h3.host)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict,
       round(bound, 6) AS bound
FROM j
"""


@query("op9_url_reputation", REPUTATION_SQL)
def _reputation(spark, folder):
    """A page's path ends in the number of its document, whose labels are its outcome."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    number = F.regexp_extract(reputation.host_and_path(F.col("url"))[1], r"/([0-9]+)(?:\.html)?/?$", 1)
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    known = pages.select("url", F.nullif(number, F.lit("")).try_cast("bigint").alias("doc_id"))
    outcomes = known.join(labels.select("doc_id", good.alias("good")), "doc_id")
    out = reputation.judge(pages, outcomes, RULES)
    return out.withColumn("bound", F.round("bound", 6))


@query("op10_reshard")
def _reshard(spark, folder):
    return reshard.summary(table(spark, folder, "documents"))


#: crc32 of the UTF-8 bytes (numbers) of a list, in DuckDB; `crc_table` has its 256 entries.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
_CRC_TABLE = """steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8)"""


_RUN_CRC = _CRC.format(
    bytes="list_concat(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':', ''), lambda x: CAST(ascii(x) AS BIGINT)), "
    "flatten(list_transform(string_split(run, ''), lambda x: "
    "CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) - 64 AS BIGINT)] END)))"
)
SPELLING_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
seen AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_RUN_CRC} AS h FROM seen, crc_table),
kept AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                   ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
         FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
         UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
ranked AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near,
                  row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM near),
forms AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
                 CASE WHEN r.m >= 2 * w.n THEN r.other END AS form, CASE WHEN r.m >= 2 * w.n THEN r.m END AS form_n
          FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (SELECT word, word AS at FROM forms
          UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root
FROM forms f JOIN chain c USING (word) JOIN forms e ON e.word = c.at WHERE e.form IS NULL
"""


@query("op11_spelling_variants", SPELLING_SQL)
def _spelling(spark, folder):
    return spelling.variants(table(spark, folder, "documents"))


def _merkle_sql(levels: int = 5) -> str:
    """Trees of at most 16 ** levels leaves a source and as many sources."""
    frame = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    fields = lambda text: " || ".join(map(frame, ["doc_id", "source", "lang", "n_chars", text]))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = _CRC.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")

    def tree(name: str) -> str:
        out = ""
        for k in range(levels):
            out += f""",
{name}{k + 1} AS (SELECT k, pos // 16 AS pos, (max(n) + 15) // 16 AS n,
    CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {name}{k} GROUP BY k, pos // 16),
{name}s{k} AS (SELECT k, pos, n,
    coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
    FROM {name}{k} WINDOW w AS (PARTITION BY k, pos // 16 ORDER BY pos))"""
        return out

    def climb(name: str, before: str, pos: str, key: str) -> tuple[str, str]:
        out = ""
        for k in range(levels):
            out += f""",
{name}{k} AS (SELECT f.* EXCLUDE (proof, x), proof || a || b AS proof, CASE WHEN n = 1 THEN x ELSE sha256(a || x || b) END AS x
    FROM {before} f JOIN {name[1:]}s{k} s ON s.k IS NOT DISTINCT FROM {key} AND s.pos = {pos} // {16**k})"""
            before = f"{name}{k}"
        return out, before

    lower, last = climb("fl", "f", "f.place", "f.source")
    upper, end = climb("fu", "g", "f.rank", "0")
    return f"""
WITH RECURSIVE {_CRC_TABLE},
e AS (SELECT doc_id, source, sha256({fields("text")}) AS leaf,
        CASE WHEN {crc} % 5 = 0 THEN sha256({fields(low)}) ELSE sha256({fields("text")}) END AS x FROM documents, crc_table),
f AS (SELECT *, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM e),
l0 AS (SELECT source AS k, place AS pos, leaf AS d, count(*) OVER (PARTITION BY source) AS n FROM f){tree("l")}{lower},
u0 AS (SELECT 0 AS k, k AS source, d, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM l{levels}){tree("u")},
g AS (SELECT f.*, u.pos AS rank, u.d AS subroot FROM {last} f JOIN u0 u ON u.source IS NOT DISTINCT FROM f.source){upper}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = d AS verified
FROM {end}, u{levels}
"""


@query("op12_merkle_manifest", _merkle_sql())
def _merkle(spark, folder):
    return merkle.summary(table(spark, folder, "documents"))


@query("op13_suffix_array_dedup")
def _suffixes(spark, folder):
    return suffixes.summary(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_RUN)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
