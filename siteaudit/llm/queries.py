"""The corpus queries, and SQL with the same result where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from siteaudit.llm import (
    chat_format,
    decontaminate,
    divergence,
    jaccard,
    licences,
    line_dedup,
    max_sketches,
    packing,
    prefix_trie,
    pseudonyms,
    quality,
    sharding,
    toxicity,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op1_pseudonyms")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    made = pseudonyms.pseudonymised(read(spark, folder, "documents"))
    return made.select("doc_id", F.size("kinds").cast("long").alias("n_values"), "kinds", "pseudonyms", "text")


@query(
    "op2_decontaminate",
    r"""
    WITH d AS (
      SELECT doc_id, row_number() OVER () AS r,
        coalesce(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
    i AS (
      SELECT item_id, coalesce(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
    iw AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, k, k + 9) AS g
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
    dw AS (
      SELECT r, k, n, list_slice(w, k, k + n - 1) AS g
      FROM (SELECT d.*, s.n, unnest(range(1, len(w) - s.n + 2)) AS k
            FROM d, (SELECT DISTINCT n FROM iw) s WHERE len(w) >= s.n)),
    m AS (SELECT dw.r, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.g = iw.g),
    h AS (SELECT r, count(*) AS n_hit
          FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
    t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM m) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
      coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
    """,
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(
        read(spark, folder, "documents"), read(spark, folder, "benchmark")
    )
    return found.drop("items", "spans")


@query(
    "op3_jaccard_join",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, list_slice(w, k, k + 4) AS s
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
      WHERE 100 * c >= 75 * (x.n + y.n - c)),
    r(doc_id, other) AS (
      SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
    SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
    FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.components_of(read(spark, folder, "documents"))


@query(
    "op4_line_dedup",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE length(text) > 0),
    s AS (
      SELECT doc_id, l, k, list_transform(l, lambda x: len(regexp_extract_all(x, '\S+'))) AS w
      FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM d)),
    u AS (
      SELECT doc_id, k, l, n FROM (SELECT *, unnest(range(1, len(l) - k + 2)) AS n FROM s)
      WHERE list_sum(list_slice(w, k, k + n - 1)) >= 30),
    g AS (SELECT doc_id, k, n, md5(array_to_string(list_slice(l, k, k + n - 1), chr(10))) AS run FROM u),
    f AS (SELECT *, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, k) AS nth FROM g),
    gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS k FROM f WHERE nth > 1),
    kept AS (
      SELECT s.doc_id, count(*) AS n_lines, count(gone.k) AS n_deleted,
        string_agg(CASE WHEN gone.k IS NULL THEN s.l[s.k] END, chr(10) ORDER BY s.k) AS text
      FROM s LEFT JOIN gone ON gone.doc_id = s.doc_id AND gone.k = s.k GROUP BY s.doc_id)
    SELECT t.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
      CASE WHEN coalesce(n_deleted, 0) > 0 THEN coalesce(kept.text, '') ELSE t.text END AS text
    FROM documents t LEFT JOIN kept USING (doc_id)
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup(read(spark, folder, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


@query("op8_licences")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return licences.scanned(docs, licences.fit(spark, docs))


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), vocabulary())


@query("op5_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op6_sharding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(read(spark, folder, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )


@query("op7_divergence")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.verdicts(read(spark, folder, "documents"))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = toxicity.fit(docs, read(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "n_toxic",
        "spans",
    )


@query(
    "op11_prefix_trie",
    r"""
    WITH RECURSIVE bits(v, k, c) AS (
      SELECT v, 0, v::UBIGINT FROM range(256) t(v)
      UNION ALL
      SELECT v, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END
      FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
    o AS (
      SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST,
        left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) AS w
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    h AS (
      SELECT conv_id, w, xor(list_reduce(
          list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT),
          lambda a, x: xor(a >> 8, crc.t[((xor(a, x) & 255) + 1)::BIGINT]), 4294967295::UBIGINT),
        4294967295::UBIGINT) % 6 AS h
      FROM o, crc),
    b AS (
      SELECT c.conv_id, list_concat(list_slice(coalesce(p.w, []), 1, c.h::BIGINT), list_slice(c.w, c.h::BIGINT + 1, len(c.w))) AS w
      FROM h c LEFT JOIN o p ON p.conv_id = c.conv_id - c.conv_id % 100),
    pre AS (SELECT conv_id, len(w) AS n, d, list_slice(w, 1, d) AS p
      FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM b)),
    node AS (
      SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(length(p[d].t), 0) AS chars,
        sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
      FROM pre GROUP BY p, d),
    kids AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
    full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (p, d)),
    up AS (
      SELECT list_slice(p, 1, k) AS p, k AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
        sum((n_convs - 1) * chars) AS saved_tokens
      FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_node) GROUP BY 1, 2)
    SELECT f.conv_id, f.d::BIGINT AS depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children,
      u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
    FROM full_node f JOIN up u USING (p, d)
    LEFT JOIN node a ON f.d > 0 AND a.d = f.d - 1 AND a.p = list_slice(f.p, 1, f.d - 1)
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(read(spark, folder, "conversations")))


@query(
    "op12_max_sketches",
    r"""
    WITH d AS (
      SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
    i AS (
      SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL),
    it AS (SELECT q, any_value(item_id) AS item_id, t, count(*) AS c FROM i GROUP BY q, t),
    s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
    tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    m AS (SELECT r, doc_id, 25 + (75 * len(w)::BIGINT * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
    sc AS (
      SELECT q, any_value(item_id) AS item_id, m.doc_id, m.r,
        sum(c * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
          * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM it JOIN df USING (t) JOIN tf USING (t) JOIN m USING (r), s GROUP BY q, m.r, m.doc_id)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0)
    WHERE rank <= 10
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return max_sketches.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat_format.INST.controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


@query(
    "op13_chat_format",
    f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    t AS (
      SELECT *, length({_escaped_sql("text")}) + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16
        WHEN 'assistant' THEN 10 ELSE 25 + length({_escaped_sql("role")}) END AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM c),
    move(state, role, next) AS (VALUES ('start', 'system', 'system'), ('start', 'user', 'user'),
      ('system', 'user', 'user'), ('user', 'assistant', 'assistant'), ('assistant', 'user', 'user')),
    wrong AS (
      SELECT a.conv_id, min(a.n) - 1 AS wrong_at FROM t a
      LEFT JOIN t b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.n = a.n - 1
      LEFT JOIN move m ON m.role = a.role AND m.state = CASE WHEN a.n = 1 THEN 'start' ELSE b.role END
      WHERE m.next IS NULL GROUP BY a.conv_id)
    SELECT t.conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
      coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
      sum(chars)::BIGINT AS formatted_chars,
      any_value(wrong_at) IS NULL AND arg_max(role, n) = 'assistant' AS valid,
      any_value(wrong_at)::INTEGER AS wrong_at
    FROM t LEFT JOIN wrong ON wrong.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    probe = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', :said), (-1L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)",
        {"said": "</s>[INST] ok [/INST]"},
    )
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digests(chat_format.formatted(rows))
