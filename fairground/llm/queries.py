"""The queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fairground.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairground.llm.pii import digest

    return digest(_read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairground.llm.html_mincut import extract

    return extract(_read(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairground.llm.decontam import leaks

    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=5, containment=0.75)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairground.llm.embed_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"), cosine=0.95)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairground.llm.sharding import shard

    return shard(_read(spark, sf_dir, "documents"), shards=40)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairground.llm.licenses import scan

    return scan(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairground.llm.langid import fit, held_out, predict

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(docs["doc_id"])))
    found = predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairground.llm.near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), k=5, similarity=0.75)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairground.llm.chat import format_chat, read_back

    control = "</s>[INST] ok [/INST]"
    table = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{control}'), (-7L, 1L, 'assistant', '{control}') AS t(conv_id, turn, role, text)")
    return read_back(format_chat(table.union(extra)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairground.llm.fim import digest, fill_in_middle

    return digest(fill_in_middle(_read(spark, sf_dir, "documents"), rate=90, spm=20, seed=1))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairground.llm.conv_repair import damaged, digest

    return digest(damaged(_read(spark, sf_dir, "conversations")))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fairground.llm.config_packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_sharding": op6_sharding,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_best_fit_packing": op13_best_fit_packing,
}

_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')"
_WORDS = "list_filter(string_split_regex(lower(text), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+'), lambda w: w <> '')"
_SHINGLES = """SELECT DISTINCT {0}, CASE WHEN n < 5 THEN array_to_string(all_words, ' ') ELSE concat_ws(' ', w, w1, w2, w3, w4) END AS g
  FROM (SELECT *, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2, lead(w, 3) OVER p AS w3, lead(w, 4) OVER p AS w4
    FROM (SELECT {0}, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n, CASE WHEN len(w) < 5 THEN w END AS all_words
      FROM (SELECT {0}, {1} AS w FROM {2})) WINDOW p AS (PARTITION BY {0} ORDER BY i)) WHERE n < 5 OR w4 IS NOT NULL"""
_CRC = """xor(4294967295, list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT),
    lambda a, c: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, c)), 4294967295))"""
#: The steps of a row in op12: sign, state before (0 nothing, 1 system, 2 user, 3 assistant), state after, cost, letter.
_STEPS = [
    *[(x, i, i, 4, "D") for x in "suaxSUAXd" for i in range(4)],
    *[(x, i, 3 if i == 2 else 2, 3 + 3 * x.isupper(), "R") for x in "suaxSUAX" for i in range(4)],
    *[(x, i, j, 3 * x.isupper(), "K") for x in "suaSUA" for i, j in {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}[x.lower()]],
]


def _closed(s: str) -> str:
    """The four states {c, a} of a layer after insertions."""
    user = f"list_min([x for x in [{s}[3], {{'c': {s}[1].c + 3, 'a': {s}[1].a || 'I'}}, {{'c': {s}[2].c + 3, 'a': {s}[2].a || 'I'}}, {{'c': {s}[4].c + 3, 'a': {s}[4].a || 'I'}}] if x.c IS NOT NULL])"
    return f"(SELECT [{s}[1], {s}[2], u, CASE WHEN {s}[4].c IS NULL THEN {{'c': u.c + 3, 'a': u.a || 'I'}} ELSE least({s}[4], {{'c': u.c + 3, 'a': u.a || 'I'}}) END] FROM (SELECT {user} AS u))"


ORACLE_SQL = {
    "op4_decontamination": f"""
WITH d AS ({_SHINGLES.format('doc_id', _WORDS, 'documents')}), b AS ({_SHINGLES.format('item_id', _WORDS, 'benchmark')}),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(item_shingles)::BIGINT AS item_shingles,
  count(*) / any_value(item_shingles)::DOUBLE AS containment
FROM d JOIN b USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id
HAVING count(*) >= 0.75 * any_value(item_shingles)""",
    "op10_chat_formatting": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS last,
  sum(8 + length(replace({_ESC.format('role')}, chr(10), '&nl;')) + length({_ESC.format('text')}))
    OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (coalesce(sum(upto) FILTER (role = 'assistant'), 0) + coalesce(sum(upto) FILTER (last AND role <> 'assistant'), 0))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT doc_id, t, length(t)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
    "op12_conversation_repair": f"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
w AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM o),
p AS (SELECT *, rtrim(text, ' \t\n\v\f\r') AS bare, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM w),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM p),
g AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(CASE WHEN r IN ('s', 'u', 'a') THEN r ELSE 'x' END) WHEN r IN ('s', 'u', 'a') THEN r ELSE 'x' END AS sign FROM f),
per AS (SELECT q.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank')::BIGINT AS blank, count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate,
  count(*) FILTER (fault = 'truncated')::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN g ON q.conv_id IS NOT DISTINCT FROM g.conv_id GROUP BY q.conv_id),
e AS (SELECT * FROM (VALUES {", ".join(str(x) for x in _STEPS)}) AS t(sign, i, j, c, a)),
z AS (SELECT [{{'c': 0, 'a': ''}}, NULL, {{'c': 3, 'a': 'I'}}, {{'c': 6, 'a': 'II'}}] AS s),
l(conv_id, i, n, s) AS (SELECT conv_id, 0, n, s FROM per, z
  UNION ALL SELECT conv_id, i + 1, n, {_closed("s")} FROM (
    SELECT l.conv_id, l.i, l.n, [list_min([{{'c': l.s[x.i + 1].c + x.c, 'a': l.s[x.i + 1].a || x.a}} for x in y.e if x.j = j AND l.s[x.i + 1].c IS NOT NULL]) for j in range(4)] AS s
    FROM l JOIN g ON l.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = l.i + 1 JOIN (SELECT sign, list({{'i': i, 'j': j, 'c': c, 'a': a}}) AS e FROM e GROUP BY sign) y ON y.sign = g.sign)),
b AS (SELECT conv_id, least(CASE WHEN s[1].c IS NULL THEN s[4] ELSE s[1] END, s[4]) AS s FROM l WHERE i = n),
v AS (SELECT conv_id, s.a AS audit, unnest(range(1, length(s.a) + 1)) AS k, substr(s.a, k, 1) AS x FROM b),
u AS (SELECT *, count(*) FILTER (x <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i, count(*) FILTER (x <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS made FROM v),
h AS (SELECT u.conv_id, k, x, made, CASE WHEN x = 'I' THEN '' ELSE g.text END AS text, CASE WHEN x = 'K' THEN g.role END AS kept FROM u LEFT JOIN g ON u.conv_id IS NOT DISTINCT FROM g.conv_id AND u.i = g.i AND x <> 'I' WHERE x <> 'D'),
y AS (SELECT conv_id, k, text, coalesce(kept, CASE WHEN (made + (max(CASE WHEN made = 1 AND left(kept, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id))) % 2 = 1 THEN 'user' ELSE 'assistant' END) AS role FROM h)
SELECT per.conv_id, gaps, blank, duplicate, truncated, illegal, b.s.c::BIGINT AS cost, b.s.a AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM per JOIN b ON per.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY k) AS whole FROM y GROUP BY conv_id) r ON per.conv_id IS NOT DISTINCT FROM r.conv_id""",
}
