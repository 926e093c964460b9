"""Registered queries of the subpackage, and their SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, conversation, decontam, divergence, langid, license, linedup, minhash, mixing, resample, suffixdup, warc

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """In a local session, Python workers find this package where the driver does; clusters get it by --py-files."""
    sc = spark.sparkContext
    if sc.master.startswith("local["):
        paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    # texts may be very long: a batch for Python is bounded by bytes, not by rows alone
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", langid.held_out(docs))
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", *mixing.COLUMNS)


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    is_target = F.expr("quality = 1 AND coalesce(toxic, 0) = 0")
    share = resample.target_share(labels, F.expr("quality IS NOT NULL"), is_target)
    return resample.resample(table(spark, sf_dir, "documents"), labels.where(is_target).select("doc_id"), keep=share)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdup.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      "contaminated")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=5, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op11_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    lexicon = bpe.compile_lexicon(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
    out = docs.select("doc_id", bpe.encode(F.col("text"), lexicon).alias("ids"))
    out = out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest(F.col("ids")).alias("ids_sha256"),
                     bpe.decode(F.col("ids"), lexicon).alias("decoded"))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversation.summary(conversation.repair(conversation.damaged(rows)))
    found = found.withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return every.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_cross_polytope_ann, op2_language_id, op3_warc_bundles, op4_pfair_mixing,
                                 op5_importance_resampling, op6_line_dedup, op7_license_scan, op8_suffix_dedup,
                                 op9_benchmark_decontamination, op10_minhash_near_dedup, op11_transducer_bpe,
                                 op12_conversation_repair, op13_source_divergence)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _longer(script: str, cost: str, letter: str) -> str:
    """SQL: a script (12 digits of cost, then letters) with one letter more."""
    return f"(lpad(CAST(CAST(substr({script}, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({script}, 13) || '{letter}')"


ORACLE: dict[str, str] = {
    "op3_warc_bundles": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
            FROM pages)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM p""",
    "op6_line_dedup": f"""
        WITH split AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM split),
        shared AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
            SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
            FROM keyed k LEFT JOIN shared s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op9_benchmark_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        grams AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
                lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS gram
            FROM b WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM grams),
        places AS (
            SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p,
                   unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
            FROM d, sizes WHERE len(w) >= n),
        hits AS (SELECT p.doc_id, p.p, p.n, g.item_id FROM places p JOIN grams g ON p.n = g.n AND p.gram = g.gram),
        covered AS (
            SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
               sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id""",
    "op10_minhash_near_dedup": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS sh FROM d),
        cls AS (SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
        flat AS (SELECT rep, n, unnest(sh) AS x FROM cls),
        freq AS (SELECT x, count(*) AS f FROM flat GROUP BY x HAVING count(*) > 1),
        ranked AS (
            SELECT rep, n, flat.x, row_number() OVER (PARTITION BY rep ORDER BY coalesce(f, 1), flat.x) AS r, f
            FROM flat LEFT JOIN freq ON flat.x = freq.x),
        prefix AS (SELECT rep, n, x FROM ranked WHERE f IS NOT NULL AND r <= n - ceil(0.85 * n) + 1),
        cand AS (
            SELECT DISTINCT a.rep AS a, b.rep AS b FROM prefix a JOIN prefix b ON a.x = b.x
            WHERE a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
        link AS (
            SELECT c.a, c.b FROM cand c JOIN cls x ON x.rep = c.a JOIN cls y ON y.rep = c.b
            WHERE 185 * len(list_intersect(x.sh, y.sh)) >= 85 * (x.n + y.n)),
        both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (
            SELECT rep AS node, rep AS root FROM cls
            UNION
            SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b),
        comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(comp.root, s.doc_id) AS component_id,
               s.doc_id = coalesce(comp.root, s.doc_id) AS kept
        FROM s LEFT JOIN cls ON cls.sh = s.sh AND len(s.sh) > 0 LEFT JOIN comp ON comp.node = cls.rep""",
    # each row of a conversation is two steps, insertions and the row itself; a place's best script so far is cost and letters in one string
    "op12_conversation_repair": rf"""
        WITH crc AS (
            SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
        said AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        dealt AS (
            SELECT conv_id, turn, role, text, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS fault FROM said, crc),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM dealt WHERE fault <> 0),
        numbered AS (
            SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
                   rtrim(text, {_BLANK}) AS body FROM damaged),
        judged AS (
            SELECT *, CASE WHEN body = '' THEN 'blank' WHEN rn > min(rn) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                   left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS x0 FROM numbered),
        steps AS (
            SELECT conv_id, [['000000000000', NULL, NULL, NULL]] || flatten(list([['I', '', ''],
                       [x, CASE WHEN fault IN ('blank', 'duplicate') THEN 'y' ELSE '' END, CASE WHEN fault = 'truncated' THEN '1' ELSE '0' END]] ORDER BY rn))
                       || [['I', '', '']] AS s,
                   coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
                   count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                   count(*) FILTER (WHERE x0 || x NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id),
        solved AS (
            SELECT * EXCLUDE (s), list_reduce(s, lambda a, r: CASE WHEN r[1] = 'I' AND r[2] = '' AND r[3] = '' THEN [
                a[1], a[2],
                least(a[3], {_longer("least(a[1], a[2], a[4])", "2", "I")}),
                least(a[4], {_longer("a[3]", "2", "I")}, {_longer(_longer("least(a[1], a[2])", "2", "I"), "2", "I")})]
              ELSE [
                {_longer("a[1]", "3", "D")},
                least({_longer("a[2]", "3", "D")}, CASE WHEN r[2] = '' AND r[1] = 's' THEN {_longer("a[1]", "CAST(r[3] AS BIGINT)", "K")} END),
                least({_longer("a[3]", "3", "D")}, CASE WHEN r[2] = '' AND r[1] = 'u' THEN {_longer("least(a[1], a[2], a[4])", "CAST(r[3] AS BIGINT)", "K")} END,
                      CASE WHEN r[2] = '' THEN {_longer("least(a[1], a[2], a[4])", "2 + CAST(r[3] AS BIGINT)", "R")} END),
                least({_longer("a[4]", "3", "D")}, CASE WHEN r[2] = '' AND r[1] = 'a' THEN {_longer("a[3]", "CAST(r[3] AS BIGINT)", "K")} END,
                      CASE WHEN r[2] = '' THEN {_longer("a[3]", "2 + CAST(r[3] AS BIGINT)", "R")} END)] END) AS best FROM steps),
        scripts AS (SELECT * EXCLUDE (best), CAST(substr(least(best[1], best[4]), 1, 12) AS BIGINT) AS cost, substr(least(best[1], best[4]), 13) AS audit FROM solved),
        letters AS (
            SELECT conv_id, unnest(string_split(audit, '')) AS c, generate_subscripts(string_split(audit, ''), 1) AS j,
                   length(replace(audit, 'D', '')) % 2 AS odd FROM scripts WHERE audit <> ''),
        placed AS (
            SELECT *, count(*) FILTER (WHERE c <> 'I') OVER w AS rn, count(*) FILTER (WHERE c <> 'D') OVER w AS nth FROM letters
            WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
        repaired AS (
            SELECT p.conv_id, string_agg(CASE WHEN c = 'K' THEN n.role WHEN (nth - 1 + odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' ||
                       CASE WHEN c = 'I' THEN '' ELSE n.text END, chr(10) ORDER BY j) AS t
            FROM placed p LEFT JOIN numbered n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.rn = p.rn WHERE c <> 'D' GROUP BY p.conv_id)
        SELECT e.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
               sha256(coalesce(t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN scripts s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
        LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op13_source_divergence": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        flat AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM flat GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
        langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
        cells AS (
            SELECT f.lang, f.source, f.term, count(*)::HUGEINT AS n FROM flat f JOIN kept k ON f.lang = k.lang AND f.term = k.term
            GROUP BY f.lang, f.source, f.term),
        totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cells GROUP BY lang, source),
        groups AS (SELECT DISTINCT lang, source FROM d),
        priced AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p,
                   1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
            FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
            LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
            LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        apart AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0) AS value
            FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
            LEFT JOIN apart x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM priced WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
        FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
