"""One query per operator, each over its whole table, beside SQL where SQL can state the result."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import (
    bpe,
    chat,
    exact_dedup,
    fill_middle,
    line_dedup,
    merkle,
    minhash_dedup,
    packing,
    quality_rules,
    secret_scan,
    substring_dedup,
    token_counts,
    toxicity,
)
from factorloom.llm.shared import stored
from factorloom.plans.registry import Query, Run

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run: Run) -> Run:
        QUERIES[name] = Query(run, sql)
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
counts AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
lines AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_dup_lines
  FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM d),
windows AS (SELECT doc_id, p, array_to_string(words[p:p + 7], ' ') AS w FROM places),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT c)::BIGINT AS n_repeat_words
            FROM (SELECT doc_id, unnest(range(p, p + 8)) AS c FROM again) GROUP BY 1),
m AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM counts LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
             + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT
             + 32 * (2 * n_dup_lines > n_lines)::BIGINT) AS failures FROM m)
SELECT *, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept FROM f"""


@query("op1_quality_rules", _QUALITY)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir))


@query("op2_secret_scans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.best_fit(documents(spark, sf_dir), path, capacity=2048)


_ESCAPED = r"regexp_replace(coalesce({0}, ''), '<(\\*)(/?turn)', '<\\\1\2', 'g')"
_CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
         AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       sum(20 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


@query("op4_chat_formatting", _CHAT)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.formatted(chat.table_turns(rows.unionByName(planted))))


_PASSAGES = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, p, md5(array_to_string(words[p:p + 49], ' ')) AS w
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM d)),
gone AS (SELECT DISTINCT doc_id, c FROM (
  SELECT doc_id, unnest(range(p, p + 50)) AS c
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS least FROM w) WHERE doc_id > least)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS c FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY c) AS text
         FROM each ANTI JOIN gone USING (doc_id, c) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query("op5_substring_dedup", _PASSAGES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(spark, documents(spark, sf_dir), window=50)


_NEAR = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[p:p + 3], ' ')) AS s
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS p FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept
FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a"""


@query("op6_minhash_dedup", _NEAR)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(documents(spark, sf_dir), size=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_bpe_codec")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


_LINES = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(shared.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE shared.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN shared USING (key) GROUP BY doc_id"""


@query("op9_line_dedup", _LINES)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir), min_documents=10, min_points=1)


_EXACT = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(translate(coalesce(text, ''), {_BLANKS}, '')) AS text_sha256
  FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r"""


@query("op10_exact_dedup", _EXACT)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter a new index, in two batches by a hash of their id; the result is stored, so the index can go afterwards."""
    table = f"exact_dedup_{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    later = F.coalesce(F.xxhash64("doc_id") % 2 != 0, F.lit(False))
    try:
        return stored(exact_dedup.duplicates(spark, [docs.where(~later), docs.where(later)], table), "exact-dedup")
    finally:
        exact_dedup.drop_index(spark, table)


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: bytes enter one by one, eight bits each."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"


_LEAF = " || ".join(
    f"coalesce(octet_length(encode(({name})::VARCHAR)) || ':' || ({name})::VARCHAR, '-')" for name in ("doc_id", "source", "lang", "n_chars")
)
_TEXT_FIELD = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"
_RUN = "coalesce(string_agg(y.digest, '' ORDER BY y.place) FILTER (WHERE y.place {0} x.place), '')"
_MERKLE = f"""
WITH RECURSIVE l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size
  FROM (SELECT doc_id, source, text IS NOT NULL AND coalesce({crc32_sql('doc_id::VARCHAR')} % 2 = 0, false) AS changed,
               sha256({_LEAF} || {_TEXT_FIELD.format('text')}) AS leaf,
               sha256({_LEAF} || {_TEXT_FIELD.format("replace(text, chr(10), '')")}) AS tampered FROM documents)),
nodes AS (
  SELECT source, 0::BIGINT AS level, place, size, leaf AS digest FROM l
  UNION ALL
  SELECT source, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM nodes WHERE size > 1 GROUP BY source, level, place // 3, size),
subs AS (SELECT source, level AS levels, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size
         FROM nodes WHERE size = 1),
tops AS (
  SELECT 0::BIGINT AS level, place, size, digest FROM subs
  UNION ALL
  SELECT level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM tops WHERE size > 1 GROUP BY level, place // 3, size),
lower AS (
  SELECT x.source, x.level, x.place, {_RUN.format('<')} AS lefts, {_RUN.format('>')} AS rights
  FROM nodes x JOIN nodes y ON x.source IS NOT DISTINCT FROM y.source AND x.level = y.level AND x.place // 3 = y.place // 3
  WHERE x.size > 1 GROUP BY 1, 2, 3),
upper AS (
  SELECT x.level, x.place, {_RUN.format('<')} AS lefts, {_RUN.format('>')} AS rights
  FROM tops x JOIN tops y ON x.level = y.level AND x.place // 3 = y.place // 3 WHERE x.size > 1 GROUP BY 1, 2),
paths AS (
  SELECT l.source, l.place, s.level, s.lefts, s.rights FROM l JOIN lower s
    ON s.source IS NOT DISTINCT FROM l.source AND s.place = l.place // (3 ** s.level)::BIGINT
  UNION ALL
  SELECT l.source, l.place, subs.levels + u.level, u.lefts, u.rights FROM l JOIN subs ON l.source IS NOT DISTINCT FROM subs.source
    JOIN upper u ON u.place = subs.place // (3 ** u.level)::BIGINT),
folds AS (
  SELECT source, place, 0::BIGINT AS level, CASE WHEN changed THEN tampered ELSE leaf END AS digest FROM l
  UNION ALL
  SELECT f.source, f.place, f.level + 1, sha256(p.lefts || f.digest || p.rights)
  FROM folds f JOIN paths p ON f.source IS NOT DISTINCT FROM p.source AND f.place = p.place AND f.level = p.level),
ends AS (SELECT source, place, arg_max(digest, level) AS folded_root FROM folds GROUP BY 1, 2),
proofs AS (SELECT source, place, string_agg(lefts || rights, '' ORDER BY level) AS proof FROM paths GROUP BY 1, 2),
top AS (SELECT digest AS root FROM tops WHERE size = 1)
SELECT l.doc_id, l.leaf, subs.digest AS subroot, top.root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN subs ON l.source IS NOT DISTINCT FROM subs.source JOIN ends ON ends.source IS NOT DISTINCT FROM l.source AND ends.place = l.place
LEFT JOIN proofs ON proofs.source IS NOT DISTINCT FROM l.source AND proofs.place = l.place CROSS JOIN top"""


@query("op11_merkle_manifest", _MERKLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.translate("text", "\n", ""))
    return merkle.verified(merkle.manifest(documents(spark, sf_dir), tampered))


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_GROUP = "('0x' || substr(sha256('7:' || doc_id), {0}, 8))::BIGINT"
_FILL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS lines,
         {', '.join(f'{_GROUP.format(1 + 8 * i)} AS h{i + 1}' for i in range(4))} FROM documents),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix
      FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""


@query("op13_fill_in_middle", _FILL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = documents(spark, sf_dir).select("doc_id", "text")
    whole = fill_middle.restored(fill_middle.fill_in_middle(source, rate_percent=100, spm_percent=50, seed=7))
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256).alias(f"{name}_sha256")
    return whole.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
