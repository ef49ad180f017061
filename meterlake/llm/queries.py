"""The operators' queries over whole tables, and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import (
    bpe,
    chat_format,
    decontaminate,
    exact_dedup,
    html_extract,
    jaccard_join,
    licenses,
    periodic_runs,
    sentence_dedup,
    spelling_variants,
    suffix_dedup,
    toxicity,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, k=5)
    return found.select(
        "doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents"), k=5, threshold=0.8)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.in_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op6_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_dedup.repeated_sentences(_table(spark, sf_dir, "documents"), span=3)
    return found.select("doc_id", "n_sentences", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.concat_ws(",", "notices"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.main_text(pages, html_extract.fit(pages))


#: Text of the documents that are given a periodic end: every tenth by the CRC-32 of its id, from word ``a`` on
#: with period ``p``.
_PLANTED = {
    "h": "crc32(CAST(doc_id AS STRING))", "w": r"CASE WHEN h % 10 = 0 THEN regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) END", "g": "h DIV 10",
    "a": "CASE WHEN size(w) > 0 THEN CAST(g % size(w) AS INT) END", "p": "CAST(1 + (size(w) - a) DIV (3 + g % 8) AS INT)",
    "text": "CASE WHEN p > 0 THEN array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), CAST(ceil((size(w) - a) / p) AS INT))), 1, size(w) - a)), ' ') ELSE text END",
}


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, value in _PLANTED.items():
        docs = docs.withColumn(name, F.expr(value))
    found = periodic_runs.periodic_runs(docs, least=12)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.select("doc_id", "runs", "collapsed", longest.alias("top"), told.alias("told"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length DIV -top.period").alias("exponent_milli"), F.sha2(F.array_join("told", "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.vocabulary(_table(spark, sf_dir, "documents"), least_letters=6, least_count=5, every=199)
    return spelling_variants.variants(words, ratio=5)


#: A conversation that speaks the marks of a template.
_ODD_TURNS = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(_ODD_TURNS))
    back = chat_format.read_back(chat_format.examples(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_sentence_dedup": op6_sentence_dedup,
    "op7_bpe": op7_bpe,
    "op8_licenses": op8_licenses,
    "op9_warc": op9_warc,
    "op10_html": op10_html,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_chat_format": op13_chat_format,
}

#: The words of a text column: lower-cased A-Z, cut at ASCII that is neither letter nor digit.
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spelled_sql(text: str) -> str:
    out = f"' ' || regexp_replace(regexp_replace(lower({text}), '©|\\(c\\)', ' copyright ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    out = f"regexp_replace({out}, ' +', '  ', 'g')"
    for word, plain in licenses.SPELLINGS:
        out = f"replace({out}, ' {word.replace(' ', '  ')} ', ' {plain.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _canonical_sql(line: str) -> str:
    out = _spelled_sql(line)
    return f"CASE WHEN regexp_matches({out}, '{licenses.COPYRIGHT}') THEN '' ELSE {out} END"


_RAW_LINES = "string_split(coalesce(text, ''), chr(10))"
_LINES_SQL = f"list_filter(list_transform({_RAW_LINES}, lambda l: {_canonical_sql('l')}), lambda x: x <> '')"
#: The entire text but for the lines that state a copyright.
_WHOLE_SQL = _spelled_sql(f"array_to_string(list_filter({_RAW_LINES}, lambda l: NOT regexp_matches({_spelled_sql('l')}, '{licenses.COPYRIGHT}')), chr(10))")

def _crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, bit by bit: each byte comes in with seven zeros behind it."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::BIGINT)"
    bits = f"list_prepend(4294967295::BIGINT, flatten(list_transform({octets}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0])))"
    return f"xor(list_reduce({bits}, lambda x, v: xor(xor(x, v) >> 1, 3988292384 * (xor(x, v) & 1))), 4294967295)"


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for mark in chat_format.CONTROL:
        out = f"replace({out}, {_quoted(mark)}, {_quoted(mark[0] + chr(92) + mark[1:])})"
    return out


_BLANK, _W = sentence_dedup.SPACE, sentence_dedup.WINDOW

ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        item_windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
            FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
        doc_windows AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM d, (SELECT DISTINCT n FROM item_windows), unnest(range(1, len(w) - n + 2)) AS r(i)),
        hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, g)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
        named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op3_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
              FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE k >= 0.8 * (x.n + y.n - k)),
        reach(doc_id, o) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN link ON o = a)
        SELECT reach.doc_id, min(o) AS class_id, (SELECT count(*) FROM link WHERE a = reach.doc_id) AS n_links FROM reach GROUP BY reach.doc_id
    """,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_sentence_dedup": f"""
        WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
        raw AS (SELECT doc_id, text, regexp_extract_all(text, {_quoted(sentence_dedup.SENTENCE)}) AS raw FROM d),
        sentence AS (SELECT doc_id, text, i, raw[i] AS x, regexp_extract_all(raw[i], '[^{_BLANK}]+[{_BLANK}]*') AS p FROM raw, unnest(range(1, len(raw) + 1)) AS t(i)),
        hashed AS (SELECT *, list_transform(p, lambda w: substr(md5(regexp_replace(w, '[{_BLANK}]+$', '')), 1, 16)) AS h FROM sentence WHERE len(p) > {sentence_dedup.LONG}),
        ended AS (SELECT doc_id, text, i, p, list_sort(list_distinct(list_append(list_transform(range(1, len(p) - {_W - 2}), lambda j:
                      j + {_W} - list_position(list_reverse(h[j:j + {_W - 1}]), list_min(h[j:j + {_W - 1}]))), len(p)))) AS e FROM hashed),
        piece AS (SELECT doc_id, text, i, list_transform(e, lambda z, j: array_to_string(p[coalesce(CASE WHEN j > 1 THEN e[j - 1] END, 0) + 1:z], '')) AS s FROM ended
                  UNION ALL SELECT doc_id, text, i, [x] FROM sentence WHERE len(p) <= {sentence_dedup.LONG}),
        cut AS (SELECT doc_id, text, flatten(list(s ORDER BY i)) AS s FROM piece GROUP BY ALL),
        b AS (SELECT doc_id, text, s, list_transform(s, lambda x: regexp_replace(x, '[{_BLANK}]+$', '')) AS u FROM cut),
        r AS (SELECT doc_id, text, i, u[i:i + 2] AS run FROM b, unnest(range(1, len(u) - 1)) AS t(i)),
        later AS (SELECT doc_id, text, i FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM r) WHERE k > 1),
        gone AS (SELECT doc_id, text, list(DISTINCT j) AS g FROM later, unnest([i, i + 1, i + 2]) AS t(j) GROUP BY ALL)
        SELECT o.doc_id, coalesce(len(s), 0)::BIGINT AS n_sentences, coalesce(len(g), 0)::BIGINT AS n_removed,
               sha256(CASE WHEN g IS NULL THEN coalesce(o.text, '') ELSE
                   regexp_extract(o.text, '^[{_BLANK}]*') || array_to_string(list_filter(s, lambda x, i: NOT list_contains(g, i)), '') END) AS kept_sha256
        FROM documents o LEFT JOIN b ON o.doc_id IS NOT DISTINCT FROM b.doc_id AND coalesce(o.text, '') = b.text
        LEFT JOIN gone ON b.doc_id IS NOT DISTINCT FROM gone.doc_id AND b.text = gone.text
    """,
    "op8_licenses": f"""
        WITH known_texts(license, text) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.KNOWN)}),
        known AS (SELECT sha256({_WHOLE_SQL}) AS digest, min(license) AS license FROM known_texts GROUP BY 1),
        d AS (SELECT doc_id, {_LINES_SQL} AS lines, {_WHOLE_SQL} AS whole FROM documents),
        w AS (SELECT doc_id, lines, CASE WHEN whole <> '' THEN sha256(whole) END AS digest FROM d),
        f AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n
              FROM (SELECT doc_id, unnest(lines) AS line FROM d) JOIN known ON sha256(line) = known.digest GROUP BY doc_id)
        SELECT w.doc_id, w.digest AS canonical_sha256, known.license, coalesce(notices, '') AS notices, coalesce(n, 0)::BIGINT AS n_notices
        FROM w LEFT JOIN known ON w.digest = known.digest LEFT JOIN f ON w.doc_id = f.doc_id
    """,
    "op9_warc": """
        WITH d AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, coalesce(html, '') AS payload,
                   sha1(coalesce(html, '')) AS h
            FROM pages)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
               translate(list_aggregate(list_transform(range(8), lambda i:
                   lpad(to_base(('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT, 32), 4, '0')), 'string_agg', ''),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
               CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
        FROM d WINDOW w AS (PARTITION BY payload)
    """,
    "op11_periodic_runs": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o, {_crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
        c AS (SELECT *, len(o) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM d),
        e AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM c),
        t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM e),
        grams AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 6], ' ') AS g FROM t, unnest(range(n - 5)) AS u(i)),
        agree AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
        islands AS (SELECT doc_id, q, min(i) AS s, max(i) + 6 + q AS f
                    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM agree) GROUP BY doc_id, q, k),
        runs AS (SELECT doc_id, s, f, min(q) AS q FROM islands WHERE f - s >= greatest(12, 2 * q) GROUP BY doc_id, s, f),
        gone AS (SELECT doc_id, list(DISTINCT j) AS j FROM runs, unnest(range(s + q, f)) AS u(j) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (f - s) || ',' || q || chr(10), '' ORDER BY s, q) AS told,
                         min((s - f, s, q)) AS top FROM (SELECT doc_id, s::BIGINT AS s, f::BIGINT AS f, q::BIGINT AS q FROM runs) GROUP BY doc_id)
        SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top[2] AS start, -top[1] AS length, top[3] AS period, (1000 * -top[1]) // top[3] AS exponent_milli,
               sha256(coalesce(told, '')) AS runs_sha256,
               sha256(array_to_string(CASE WHEN j IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(j, i - 1)) END, ' ')) AS collapsed_sha256
        FROM t LEFT JOIN found USING (doc_id) LEFT JOIN gone USING (doc_id)
    """,
    "op12_spelling_variants": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS r FROM documents),
        runs AS (SELECT doc_id, r, count(*) AS n FROM d WHERE length(r) >= 6 GROUP BY ALL),
        told AS (SELECT *, {_crc32_sql("doc_id || ':' || r")} AS h FROM runs),
        v AS (SELECT word, sum(n)::BIGINT AS n FROM (
                  SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM told)
              WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
        pairs AS (
            SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION SELECT x.word, v.word, v.n FROM cut x JOIN v ON v.word = x.a || x.b
            UNION SELECT v.word, y.word, y.n FROM cut y JOIN v ON v.word = y.a || y.b),
        near AS (SELECT word, count(*) AS n_near, min((-m, other)) AS top FROM pairs GROUP BY word),
        forms AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 5 * n THEN top[2] END AS form, CASE WHEN -top[1] >= 5 * n THEN -top[1] END AS form_n
                  FROM v LEFT JOIN near USING (word)),
        steps(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT steps.word, form FROM steps JOIN forms ON forms.word = root WHERE form IS NOT NULL),
        ends AS (SELECT steps.word, root FROM steps JOIN forms ON forms.word = root WHERE form IS NULL)
        SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN ends USING (word)
    """,
    "op13_chat_format": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(i, r)),
        w AS (SELECT *, length({_quoted(chat_format.START + chat_format.SEPARATOR + chat_format.END)} || {_escaped_sql("role")} || {_escaped_sql("text")}) AS size FROM c),
        s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS so_far,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM w)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (sum(so_far) FILTER (role = 'assistant' OR last))::BIGINT AS formatted_chars
        FROM s GROUP BY conv_id
    """,
}
