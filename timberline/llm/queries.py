"""The registered corpus queries and, where SQL can say it, their DuckDB SQL.

Each query applies one operator with its default parameters to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import passages, toxicity
from timberline.llm.fertility import fertility_rules
from timberline.llm.licenses import BLOCK_LINES, PHRASES, TEMPLATES, THRESHOLD, license_scan, needed, template_words
from timberline.llm.minmax import near_duplicates
from timberline.llm.mixing import mix_plan
from timberline.llm.prefix_trie import numbered_turns, prefix_trie
from timberline.llm.structure_repair import repair_digests
from timberline.llm.substrings import remove_repeats
from timberline.llm.surrogates import replace_entities
from timberline.llm.templates import drop_templates
from timberline.llm.tiling import contamination
from timberline.llm.token_files import token_output
from timberline.session import checkpointed

# Whoever runs the query for real sets a key of their own.
SURROGATE_KEY = "example key"
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@dataclass(frozen=True)
class Case:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def id_remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def training_labels(spark: SparkSession, sf: str, column: str, modulus: int, held_out: int) -> DataFrame:
    """(``doc_id``, ``label``) of the documents that may be learned from."""
    rows = table(spark, sf, "labels").where(id_remainder(modulus) != held_out)
    return rows.select("doc_id", F.col(column).alias("label"))


def _scored(spark: SparkSession, sf: str, model, modulus: int, held_out: int) -> DataFrame:
    scored = documents(spark, sf).select(
        "doc_id",
        F.coalesce(id_remainder(modulus) == held_out, F.lit(False)).alias("held_out"),
        model.column(F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    found = drop_templates(documents(spark, sf))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS number FROM documents),
parsed AS (SELECT doc_id, number, line,
    [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END
     FOR t IN regexp_extract_all(line, '[^\x20\x09-\x0D]+')] AS tokens FROM lines),
worded AS (SELECT *, array_to_string([CAST(len(tokens) AS VARCHAR)] || tokens[1:3], ' ') AS leaf FROM parsed WHERE len(tokens) > 0),
leaves AS (SELECT leaf, count(DISTINCT doc_id) AS leaf_docs FROM worded GROUP BY leaf HAVING count(DISTINCT doc_id) >= 4),
distinct_lines AS (SELECT DISTINCT doc_id, leaf, tokens FROM worded JOIN leaves USING (leaf)),
places AS (SELECT doc_id, leaf, tokens, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM distinct_lines),
often AS (SELECT leaf, place, token, CAST(ceil(log2(any_value(leaf_docs) / count(DISTINCT doc_id)) - 1e-9) AS INT) AS rank
    FROM places JOIN leaves USING (leaf) GROUP BY leaf, place, token HAVING count(DISTINCT doc_id) >= 4),
constant AS (SELECT leaf, tokens, list({'rank': rank, 'place': place, 'token': token} ORDER BY rank, place, token) AS found
    FROM (SELECT DISTINCT leaf, tokens, place, token FROM places) JOIN often USING (leaf, place, token) GROUP BY leaf, tokens),
fixed AS (SELECT leaf, tokens, [x.place || ':' || x.token FOR x IN found IF x.rank <= found[enough].rank] AS template
    FROM (SELECT *, greatest(1, CAST(ceil(CAST(0.6 AS DOUBLE) * len(tokens)) AS INT)) AS enough FROM constant) WHERE len(found) >= enough),
placed AS (SELECT doc_id, leaf, tokens, template FROM distinct_lines JOIN fixed USING (leaf, tokens)),
recurring AS (SELECT leaf, template FROM placed GROUP BY ALL HAVING count(DISTINCT doc_id) >= 4),
gone AS (SELECT DISTINCT doc_id, tokens FROM placed JOIN recurring USING (leaf, template)),
marked AS (SELECT p.*, g.doc_id IS NOT NULL AS dropped FROM parsed p
    LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.tokens = g.tokens AND len(p.tokens) > 0)
SELECT doc_id, count(*) FILTER (len(tokens) > 0) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def op2_quality_mil(spark: SparkSession, sf: str) -> DataFrame:
    model = passages.fit(documents(spark, sf), training_labels(spark, sf, "quality", 3, 1))
    return _scored(spark, sf, model, 3, 1)


def op3_string_tiling(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(documents(spark, sf), table(spark, sf, "benchmark"))


def op4_suffix_repeats(spark: SparkSession, sf: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = rf"""
WITH w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS s, ws FROM w),
heads AS (SELECT doc_id, s, sha256(array_to_string(ws[s:s + 34], ' ')) AS k FROM starts),
twice AS (SELECT k FROM heads GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM heads JOIN twice USING (k)),
places AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, ws FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(ws[p], ' ' ORDER BY p) AS text
         FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def op5_minmax_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(documents(spark, sf))


OP5_SETS = r"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {docs}),
sets AS (SELECT doc_id, CASE WHEN len(ws) >= 5
    THEN list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shingles FROM w),
flat AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
near AS (SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b USING (shingle)
    GROUP BY x, y, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x),
groups AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)"""

OP5_SQL = f"""
WITH RECURSIVE {OP5_SETS.format(docs="documents")}
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN groups USING (doc_id)"""


def op6_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return replace_entities(documents(spark, sf), key=SURROGATE_KEY)


def op7_fertility(spark: SparkSession, sf: str) -> DataFrame:
    return fertility_rules(documents(spark, sf))


def op8_systematic_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_plan(documents(spark, sf))


OP8_SQL = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len({SQL_WORDS}) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, 3 * source_size AS cap,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM totals),
ranked AS (SELECT *, row_number() OVER o AS rank,
    coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
    coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_before,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights
    FROM weighted WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)),
level AS (SELECT arg_min(CAST(total - caps_before AS DOUBLE) / (all_weights - weights_before), rank) AS level FROM ranked
    WHERE (total - caps_before) * weight <= cap * (all_weights - weights_before)),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(level, 0) * weight) AS target FROM ranked, level),
units AS (SELECT *, least(CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END * 16777216) AS BIGINT),
    3 * 16777216) AS units, CAST('0x' || substr(md5(coalesce('mix-1:' || source, 'mix-1')), 1, 6) AS BIGINT) AS offset_units FROM targets),
placed AS (SELECT s.doc_id, s.size, u.source_size, u.target, u.units, u.offset_units
    + (row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS LAST) - 1) * u.units AS spot
    FROM sized s JOIN units u ON s.source IS NOT DISTINCT FROM u.source),
drawn AS (SELECT *, CAST((spot + units) // 16777216 - spot // 16777216 AS BIGINT) AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM drawn"""


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_output(documents(spark, sf))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    model = toxicity.fit(documents(spark, sf), training_labels(spark, sf, "toxic", 5, 0))
    return _scored(spark, sf, model, 5, 0)


def shared_heads(numbered: DataFrame, members: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % 100 in place of its own first h;
    h is the crc32 of c modulo 6."""
    heads = numbered.where((F.col("conv_id") % 100 == 0) & (F.col("place") <= 5))
    known = heads.groupBy(F.col("conv_id").alias("base")).agg(F.max("place").alias("n_base"))
    asked = members.select(
        "conv_id",
        (F.col("conv_id") - F.col("conv_id") % 100).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"),
    )
    taken = F.least("h", F.coalesce("n_base", F.lit(0).cast("bigint"))).alias("taken")
    # Frozen, so that Spark may split a conversation of very many turns in the join below.
    asked = checkpointed(asked.join(known, "base", "left").select("conv_id", "base", "h", taken))
    first = asked.select("conv_id", "base", "h").join(heads.withColumnRenamed("conv_id", "base"), "base").where("place <= h")
    rest = numbered.join(asked, "conv_id").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "place", "digest", "chars"]
    return first.select(columns).union(rest.select(columns))


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    conversations = table(spark, sf, "conversations")
    members = conversations.where(F.col("conv_id").isNotNull()).select("conv_id").distinct()
    return prefix_trie(shared_heads(numbered_turns(conversations), members), members)


# crc32 bit by bit: -1 stands for a shift by one bit.
OP11_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
asked AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END,
    CAST(4294967295 AS BIGINT))) % 6 AS h FROM ids),
numbered AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL),
bases AS (SELECT conv_id AS base, max(place) AS n_base FROM numbered GROUP BY conv_id),
rebuilt AS (SELECT a.conv_id, n.place, n.role, n.text FROM asked a JOIN numbered n ON n.conv_id = a.base AND n.place <= a.h
    UNION ALL SELECT a.conv_id, n.place - a.h + least(a.h, coalesce(b.n_base, 0)), n.role, n.text
    FROM asked a JOIN numbered n USING (conv_id) LEFT JOIN bases b USING (base) WHERE n.place > a.h),
steps AS (SELECT conv_id, place AS depth, length(text) AS chars, sha256(string_agg(sha256(length(role) || ':' || role || text), '')
    OVER (PARTITION BY conv_id ORDER BY place)) AS key FROM rebuilt UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
nodes AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM steps GROUP BY depth, key),
lasts AS (SELECT conv_id, max(depth) AS depth, arg_max(key, depth) AS key FROM steps GROUP BY conv_id),
ends AS (SELECT depth, key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM lasts GROUP BY depth, key),
parents AS (SELECT n.depth, n.key, p.depth AS parent_depth, p.key AS parent_key, p.conv_id AS parent_conv_id
    FROM nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.depth = n.depth - 1 JOIN nodes p ON p.depth = s.depth AND p.key = s.key),
children AS (SELECT parent_depth AS depth, parent_key AS key, count(*) AS n_children FROM parents GROUP BY ALL),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (depth, key)),
sums AS (SELECT s.depth, s.key, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.chars) AS saved_tokens
    FROM own o JOIN steps s ON s.conv_id = o.conv_id AND s.depth <= o.depth GROUP BY s.depth, s.key)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM own o JOIN sums USING (depth, key) LEFT JOIN parents USING (depth, key) LEFT JOIN ends USING (depth, key)"""


def op12_license_join(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan(documents(spark, sf))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SQL_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_LICENSE_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SQL_TEMPLATES = ", ".join(
    f"('{label}', {_sql_list(words)}, {needed(len(words), THRESHOLD)})" for label, words in ((label, template_words(t)) for label, t in TEMPLATES)
)
_SQL_PHRASES = ", ".join(f"('{label}', {_sql_list(phrase.split(' '))})" for phrase, label in PHRASES.items())

OP12_SQL = f"""
WITH templates(label, ts, needed) AS (VALUES {_SQL_TEMPLATES}),
phrases(label, ps) AS (VALUES {_SQL_PHRASES}),
w AS (SELECT doc_id, regexp_extract_all({_SQL_FOLD.format("coalesce(text, '')")}, {_SQL_LICENSE_WORD}) AS ws,
    string_split(text, chr(10)) AS lines FROM documents),
places AS (SELECT doc_id, label, unnest([i FOR i IN range(0, len(ws)) IF ws[i + 1:i + len(ps)] = ps]) AS start FROM w, phrases),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_distinct(list(label)) AS labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, unnest([array_to_string(lines[i:i + {BLOCK_LINES - 1}], ' ') FOR i IN range(1, greatest(len(lines) - {BLOCK_LINES - 2}, 2))]) AS block FROM w),
worded AS (SELECT doc_id, list_distinct(regexp_extract_all({_SQL_FOLD.format("block")}, {_SQL_LICENSE_WORD})) AS ws FROM blocks),
met AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(len(list_intersect(ts, ws)) / len(ts)) AS containment
    FROM worded, templates WHERE len(list_intersect(ts, ws)) >= needed GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base b USING (doc_id) LEFT JOIN met m USING (doc_id)"""


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with faults by the crc32 of ``conv_id:turn`` modulo 20; nulls are one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"),
    ).where("fault <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def op13_structure_repair(spark: SparkSession, sf: str) -> DataFrame:
    conversations = table(spark, sf, "conversations")
    return repair_digests(damaged(conversations), conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct())


CASES = [
    Case("op1_line_templates", op1_line_templates, OP1_SQL),
    Case("op2_quality_mil", op2_quality_mil),
    Case("op3_string_tiling", op3_string_tiling),
    Case("op4_suffix_repeats", op4_suffix_repeats, OP4_SQL),
    Case("op5_minmax_dedup", op5_minmax_dedup, OP5_SQL),
    Case("op6_surrogates", op6_surrogates),
    Case("op7_fertility", op7_fertility),
    Case("op8_systematic_mix", op8_systematic_mix, OP8_SQL),
    Case("op9_token_files", op9_token_files),
    Case("op10_toxicity", op10_toxicity),
    Case("op11_prefix_trie", op11_prefix_trie, OP11_SQL),
    Case("op12_license_join", op12_license_join, OP12_SQL),
    Case("op13_structure_repair", op13_structure_repair),
]
