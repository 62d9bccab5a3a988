"""The registered queries of the operators and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenequarry.llm import byte_bpe, chat_format, exact_dedup, fertility, fingerprint, lm_score, mixing, phrases, ranked_search, simhash
from scenequarry.llm import substring_dedup, toxicity, url_filter
from scenequarry.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS budget,
         coalesce(sum(2.0 * source_size) OVER up, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS free
  FROM sources WINDOW up AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT arg_min((budget - capped) / free, 2.0 * source_size / weight) FILTER (WHERE (budget - capped) / free <= 2.0 * source_size / weight) AS level FROM levels
), targets AS (
  SELECT source, source_size, least(2.0 * source_size, level * weight)::DOUBLE AS target,
         ('0x' || substr(md5('42:' || coalesce(source, '')), 1, 6))::BIGINT AS shift
  FROM levels, filled
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.shift,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS place,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 16777216 + 0.5)::BIGINT ELSE 0 END AS ratio
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((place * ratio + shift) // 16777216 - ((place - 1) * ratio + shift) // 16777216) * size AS taken
FROM placed
"""


@_query("op1_mixing", MIXING_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


EXACT_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM texts WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""


@_query("op2_exact_dedup", EXACT_SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@_query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


BPE_FILE = "byte_bpe_multi_50k.tiktoken"


@_query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


@_query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


MARKED = "</s>[INST] ok [/INST]"       # control strings as ordinary text

# formatted_chars depends on the windows; SQL checks what is read back
@_query("op3_chat_format")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], turns.schema)
    return chat_format.read_back(chat_format.format_windows(turns.unionByName(extra)))


def _url_sql() -> str:
    """The template tree over windows of distinct templates."""
    d = url_filter.DEPTH
    o, t = [f"o{i}" for i in range(1, d + 1)], [f"t{i}" for i in range(1, d + 1)]
    steps, source = [], "nodes"
    for i in range(1, d + 1):
        parent = ", ".join(["host", *t[: i - 1]])
        steps.append(f"""
kids{i} AS (SELECT {parent}, t{i}, sum(n) AS n FROM {source} WHERE t{i} <> '' GROUP BY ALL),
wide{i} AS (SELECT {parent} FROM kids{i} GROUP BY ALL HAVING count(*) >= 8 AND sum(n) < 2 * count(*)),
named{i} AS (SELECT * REPLACE (CASE WHEN t{i} <> '' AND ({parent}) IN (SELECT ({parent}) FROM wide{i}) THEN '*' ELSE t{i} END AS t{i}) FROM {source})""")
        source = f"named{i}"
    steps.append(f"""
tree AS (SELECT host, {', '.join(t)}, {', '.join(f'{x} AS {x.replace("t", "k")}' for x in t)}, sum(labelled) AS labelled, sum(blocked) AS blocked FROM {source} GROUP BY ALL),
level0 AS (SELECT *, (sum(blocked) OVER () + 4.0 * 0.5)::DOUBLE / (sum(labelled) OVER () + 4.0)::DOUBLE AS r FROM tree),
pure0 AS (SELECT * REPLACE ((sum(blocked) OVER (PARTITION BY host) + 4.0::DOUBLE * r) / (sum(labelled) OVER (PARTITION BY host) + 4.0::DOUBLE) AS r) FROM level0)""")
    for i in range(1, d + 1):
        up, here = ", ".join(["host", *t[: i - 1]]), ", ".join(["host", *t[:i]])
        steps.append(f"""
sums{i} AS (SELECT *, (sum(labelled) OVER (PARTITION BY {here}))::DOUBLE AS n, (sum(blocked) OVER (PARTITION BY {here}))::DOUBLE AS b,
  (sum(labelled) OVER (PARTITION BY {up}))::DOUBLE AS pn, (sum(blocked) OVER (PARTITION BY {up}))::DOUBLE AS pb FROM pure{i - 1}),
merged{i} AS (SELECT * EXCLUDE (n, b, pn, pb) REPLACE (CASE WHEN (b * pn - n * pb) * (b * pn - n * pb) <= 4 * n * pb * (pn - pb) AND t{i} <> '' THEN '+' ELSE t{i} END AS t{i}) FROM sums{i}),
pure{i} AS (SELECT * REPLACE ((sum(blocked) OVER (PARTITION BY {here}) + 4.0::DOUBLE * r) / (sum(labelled) OVER (PARTITION BY {here}) + 4.0::DOUBLE) AS r) FROM merged{i})""")
    rule = "CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/' " \
        "WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/' " \
        "WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' " \
        "WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END"
    parts = ", ".join(
        (f"CASE WHEN len(s) > {d} THEN '**' ELSE coalesce(s[{i}], '') END" if i == d else f"coalesce(s[{i}], '')") + f" AS o{i}" for i in range(1, d + 1)
    )
    return rf"""
WITH urls AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM urls
), given AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, len(h) + 1), '^[^?#]*') AS path FROM hosts
), ruled AS (
  SELECT *, {rule} AS rule,
         list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '{url_filter.VARIABLE}') THEN '*' ELSE x END) AS s FROM given
), cut AS (
  SELECT * EXCLUDE (s), {parts}, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS label FROM ruled
), nodes AS (
  SELECT host, {', '.join(o)}, {', '.join(f'{x} AS {x.replace("o", "t")}' for x in o)}, count(*) AS n, count(label) AS labelled, coalesce(sum(label), 0) AS blocked FROM cut GROUP BY ALL
),{','.join(steps)}
SELECT c.page_id, c.host, c.path, c.rule,
       CASE WHEN c.label = 1 THEN 'block' WHEN c.label = 0 THEN 'allow' WHEN p.r >= 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM cut c JOIN {source} q USING (host, {', '.join(o)}) JOIN pure{d} p ON q.host = p.host AND {' AND '.join(f'q.{x} = p.{x.replace("t", "k")}' for x in t)}
"""


@_query("op8_url_filter", _url_sql())
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("purity")


@_query("op5_lm_score")
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = lm_score.good_rows(table(spark, sf_dir, "labels"), toxicity.held_out(F.col("doc_id")))
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), target)


PIECE_FILE = "piece_bpe_32k.model"


@_query("op11_fertility")
def op11_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = (public_tokenizers.path(PIECE_FILE), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return fertility.judge(table(spark, sf_dir, "documents"), *files)


def _phrases_sql() -> str:
    """Every phrase exploded and counted for itself."""
    grams = "\nUNION ALL ".join(
        f"SELECT lang, array_to_string(w[i : i + {k - 1}], ' ') AS phrase, {k} AS size FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})"
        for k in range(1, 6)
    )
    return rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)
), grams AS ({grams}
), phrases AS (
  SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), longer AS (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE size >= 2
), cuts AS (
  SELECT *, array_to_string(w[1 : k], ' ') AS lhs, array_to_string(w[k + 1 : size], ' ') AS rhs FROM (SELECT *, unnest(range(1, size)) AS k FROM longer)
), rated AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = c.lhs JOIN phrases y ON y.lang = c.lang AND y.phrase = c.rhs JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT lang, a, w, s, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM longer)) GROUP BY ALL
)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score
FROM weakest LEFT JOIN held USING (lang, phrase) WHERE held IS NULL OR 100 * held < 100 * a
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER best <= 2000
"""


@_query("op12_phrases", _phrases_sql())
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), sizes AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM words WHERE len(w) > 0
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
), held AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, sizes GROUP BY term, n_docs
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), sizes GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER best)::INT AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 10
"""


@_query("op13_ranked_search", SEARCH_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
