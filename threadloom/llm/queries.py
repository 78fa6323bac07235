"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import chat, collocations, decontam, exact, langid, licences, merkle, packing, repeats, reshard, simhash, warc, wrappers
from threadloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op2_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = chat.read_back(chat.prefix_examples(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_exact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).drop("locator")


def op10_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 20 shards by a hash of the id to 24 of equal size."""
    laid = table(spark, sf_dir, "documents").withColumn("__old_shard", F.pmod(F.xxhash64("doc_id"), F.lit(20)).cast("int"))
    placed = reshard.reshard(laid, shards=24, old_col="__old_shard")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def op3_langid_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.page_responses(table(spark, sf_dir, "pages")))


def op6_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op11_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_merkle_mountains(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    without = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered={"text": without})


def op13_pair_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_chat_prefix_target": op2_chat_prefix_target,
    "op3_langid_cnn": op3_langid_cnn,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_suffix_decontamination": op5_suffix_decontamination,
    "op6_wrapper_extraction": op6_wrapper_extraction,
    "op7_licence_automaton": op7_licence_automaton,
    "op8_config_lp_packing": op8_config_lp_packing,
    "op9_exact_stream": op9_exact_stream,
    "op10_flow_reshard": op10_flow_reshard,
    "op11_prefix_doubling": op11_prefix_doubling,
    "op12_merkle_mountains": op12_merkle_mountains,
    "op13_pair_naming": op13_pair_naming,
}

ORACLES: dict[str, str] = {
    "op2_chat_prefix_target": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        )
        SELECT conv_id,
            count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(16 + length(role) + length(text)
                + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)'))) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id
    """,
    "op5_suffix_decontamination": r"""
        WITH texts AS (
            SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents
            UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), text FROM benchmark
        ), split AS (
            SELECT kind, id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM texts
        ), item AS (
            SELECT DISTINCT id AS item, k, array_to_string(w[i:i + k - 1], ' ') AS gram
            FROM (SELECT id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM split WHERE kind = 'b' AND len(w) > 0)
        ), place AS (
            SELECT id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
            FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (SELECT DISTINCT k FROM item) WHERE kind = 'd' AND len(w) >= k)
        ), hit AS (
            SELECT id, i, k, item FROM place JOIN item USING (k, gram)
        ), covered AS (
            SELECT id, count(DISTINCT pos) AS n FROM (SELECT id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT id, i, k FROM hit)) GROUP BY id
        ), items AS (
            SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id
        )
        SELECT CAST(s.id AS BIGINT) AS doc_id, len(s.w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
            sha256(coalesce(t.list, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
        FROM split s LEFT JOIN covered c USING (id) LEFT JOIN items t USING (id) WHERE s.kind = 'd'
    """,
    "op9_exact_stream": """
        SELECT doc_id,
            max(doc_id) OVER same AS keep_id,
            count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept,
            sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_prefix_doubling": """
        WITH bytes AS (
            SELECT doc_id, encode(coalesce(text, '')) AS e, strlen(coalesce(text, '')) AS n FROM documents
        ), windows AS (
            SELECT doc_id, i, e[i + 1:i + 50] AS w FROM (SELECT doc_id, e, unnest(range(0, n - 49)) AS i FROM bytes)
        ), least AS (
            SELECT w, min(doc_id) AS low FROM windows GROUP BY w HAVING max(doc_id) > min(doc_id)
        ), hit AS (
            SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS apart FROM windows JOIN least USING (w) WHERE low < doc_id
        ), numbered AS (
            SELECT doc_id, i, count(*) FILTER (WHERE apart) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit
        ), spans AS (
            SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run
        ), gaps AS (
            SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
        ), cut AS (
            SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(hex(e[before + 1:a]), '' ORDER BY a) AS head
            FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
            sha256(unhex(coalesce(head, '') || coalesce(hex(e[coalesce(last, 0) + 1:n]), ''))) AS kept_sha256
        FROM bytes LEFT JOIN cut USING (doc_id)
    """,
    "op12_merkle_mountains": r"""
        WITH RECURSIVE leaf AS (
            SELECT doc_id, source, head || body AS whole, sha256(head || body) AS leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
                sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS bad
            FROM (
                SELECT doc_id, source, coalesce(strlen(text) || ':' || text, '-') AS body,
                    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
                    CASE WHEN xor(list_reduce(list_concat([4294967295], [ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS BIGINT), 1)) for k in range(1, length(CAST(doc_id AS VARCHAR)) + 1)]),
                        lambda c, b: list_reduce([xor(CAST(c AS BIGINT), CAST(b AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
                    ), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut
                FROM documents
            )
        ), tree AS (
            SELECT source, 0 AS level, list(leaf ORDER BY doc_id) AS nodes FROM leaf GROUP BY source
            UNION ALL
            SELECT source, level + 1, [sha256(array_to_string(nodes[3 * k + 1:3 * k + 3], '')) for k in range(0, (len(nodes) + 2) // 3)] FROM tree WHERE len(nodes) > 1
        ), sub AS (
            SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM tree WHERE len(nodes) = 1
        ), top AS (
            SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM sub
            UNION ALL
            SELECT level + 1, [sha256(array_to_string(nodes[3 * k + 1:3 * k + 3], '')) for k in range(0, (len(nodes) + 2) // 3)] FROM top WHERE len(nodes) > 1
        ), climb AS (
            SELECT doc_id, source, leaf, 0 AS level, i, bad AS folded, '' AS beside FROM leaf
            UNION ALL
            SELECT c.doc_id, c.source, c.leaf, c.level + 1, i // 3,
                sha256(array_to_string(nodes[i // 3 * 3 + 1:i], '') || folded || array_to_string(nodes[i + 2:i // 3 * 3 + 3], '')),
                beside || array_to_string(nodes[i // 3 * 3 + 1:i], '') || array_to_string(nodes[i + 2:i // 3 * 3 + 3], '')
            FROM climb c JOIN tree t ON t.source IS NOT DISTINCT FROM c.source AND t.level = c.level WHERE len(nodes) > 1
        ), over AS (
            SELECT c.doc_id, c.leaf, s.subroot, 0 AS level, s.place AS i, c.folded, c.beside
            FROM climb c JOIN sub s ON s.source IS NOT DISTINCT FROM c.source JOIN tree t ON t.source IS NOT DISTINCT FROM c.source AND t.level = c.level WHERE len(nodes) = 1
            UNION ALL
            SELECT o.doc_id, o.leaf, o.subroot, o.level + 1, i // 3,
                sha256(array_to_string(nodes[i // 3 * 3 + 1:i], '') || folded || array_to_string(nodes[i + 2:i // 3 * 3 + 3], '')),
                beside || array_to_string(nodes[i // 3 * 3 + 1:i], '') || array_to_string(nodes[i + 2:i // 3 * 3 + 3], '')
            FROM over o JOIN top t ON t.level = o.level WHERE len(nodes) > 1
        )
        SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(beside) AS proof_sha256, folded AS folded_root, folded = nodes[1] AS verified
        FROM over o JOIN top t ON t.level = o.level WHERE len(nodes) = 1
    """,
    "op13_pair_naming": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), split AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), grams AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k)
        ), f AS (
            SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
        ), cand AS (
            SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
        ), inside AS (
            SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longest
            FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM cand, (VALUES (2), (3)) AS v(m) WHERE m < k) GROUP BY ALL
        ), free AS (
            SELECT c.* FROM cand c LEFT JOIN inside i ON i.lang = c.lang AND i.m = c.k AND i.phrase = c.phrase
            WHERE i.longest IS NULL OR CAST(i.longest AS HUGEINT) * 100 < CAST(c.a AS HUGEINT) * 80
        ), cuts AS (
            SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, c.j, CAST(CAST(c.a AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, k)) AS j FROM free) c
            JOIN f x ON x.lang = c.lang AND x.k = c.j AND x.phrase = array_to_string(c.w[1:c.j], ' ')
            JOIN f y ON y.lang = c.lang AND y.k = c.k - c.j AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')
        ), lowest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
        )
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
        FROM ranked JOIN (SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang) USING (lang) WHERE rank <= 2000
    """,
}
