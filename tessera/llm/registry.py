"""Queries of the llm operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontam, embeddings, line_dedup, minhash, packing, quality, secrets, sharding, toxicity
from tessera.llm.runtime import fresh_path, read


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(read(spark, sf_dir, "embeddings"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard after compaction, and the shard's size in rows."""
    store = sharding.ShardStore(spark, fresh_path(spark, "shards"), target_bytes=32 << 20)
    store.append(read(spark, sf_dir, "documents"))
    version = store.compact()
    rows = store.read(version)
    return rows.select("doc_id", F.crc32("text").alias("text_crc32"), "shard", F.lit(version).alias("version"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality.fold(5) == 0
    scores = quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out)
    return quality.decided(scores, held_out)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality.fold(4) == 2
    scores = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out)
    return quality.decided(scores, held_out)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), minhash.Params(words=3, percent=85, half=3, m=8))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.scan_secrets(read(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(read(spark, sf_dir, "documents")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as an event log (streamed, edited and regenerated turns), folded, rendered and read back."""
    said = "</s>[INST] ok [/INST]"
    control = spark.sql(f"VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    return chat.chat_digests(chat.format_chats(chat.turns_as_log(turns)))


def queries() -> dict:
    return {
        "op1_decontam": op1_decontam,
        "op2_embeddings": op2_embeddings,
        "op3_lines": op3_lines,
        "op4_sharding": op4_sharding,
        "op5_quality": op5_quality,
        "op6_toxicity": op6_toxicity,
        "op7_minhash": op7_minhash,
        "op8_secrets": op8_secrets,
        "op9_packing": op9_packing,
        "op10_chat": op10_chat,
    }


def _parts_sql(kind: str, pattern: str, group: int) -> str:
    """Matches of one kind with start, end and the length of a group."""
    re = pattern.replace("'", "''")
    return f"""
        SELECT row, doc_id, '{kind}' AS kind,
            list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS start,
            length(m[i + 1]) AS size, length(v[i + 1]) AS inner_size
        FROM (SELECT *, unnest(range(len(m))) AS i FROM (
            SELECT row, doc_id, regexp_extract_all(t, '{re}', 0) AS m, regexp_extract_all(t, '{re}', {group}) AS v, string_split_regex(t, '{re}') AS g FROM d))"""


_SECRETS = f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({" UNION ALL ".join(_parts_sql(*k) for k in (
        ("assign", secrets.ASSIGN, 2), ("access", secrets.ACCESS, 0), ("hex", secrets.HEX, 0), ("endpoint", secrets.ENDPOINT, 2), ("ident", secrets.IDENT, 2), ("bearer", secrets.BEARER, 2)))}),
    parts AS (
        SELECT row, start, start + size AS stop, CASE WHEN kind = 'assign' AND inner_size < {secrets.LEAST_ASSIGN} THEN 'weak' WHEN kind = 'bearer' THEN 'weak' ELSE kind END AS kind
        FROM found WHERE NOT (kind = 'access' AND inner_size < {secrets.LEAST_ACCESS})
    ),
    sides AS (
        SELECT a.row, a.start, a.stop, a.kind,
            max(struct_pack(stop := b.stop, start := b.start, kind := b.kind)) FILTER ((b.start, b.stop, b.kind) < (a.start, a.stop, a.kind)) AS back,
            min(struct_pack(start := b.start, stop := b.stop, kind := b.kind)) FILTER ((b.start, b.stop, b.kind) > (a.start, a.stop, a.kind)) AS ahead
        FROM parts a JOIN parts b ON a.row = b.row
            AND ((a.kind IN ('ident', 'endpoint') AND b.kind IN ('assign', 'hex', 'weak')) OR (a.kind = 'weak' AND b.kind IN ('access', 'ident', 'endpoint')))
        GROUP BY a.row, a.start, a.stop, a.kind
    ),
    near AS (
        SELECT row, start, stop, kind, CASE WHEN start - back.stop <= 256 AND (ahead IS NULL OR start - back.stop <= ahead.start - stop) THEN concat_ws(':', back.kind, back.start, back.stop)
            WHEN ahead.start - stop <= 256 THEN concat_ws(':', ahead.kind, ahead.start, ahead.stop) END AS partner FROM sides
    ),
    spans AS (
        SELECT row, start, stop, kind, list_position({secrets.KINDS}, kind) AS rank, NULL AS partner FROM parts WHERE kind IN ('assign', 'access', 'hex')
        UNION ALL SELECT row, start, stop, kind, list_position({secrets.KINDS}, kind), partner FROM near WHERE partner IS NOT NULL
    )
    SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank <= 3), '')) AS base_sha256,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop), '') AS spans,
        coalesce(string_agg(kind || ':' || start || ':' || stop || '>' || partner, ',' ORDER BY start, rank, stop) FILTER (partner IS NOT NULL), '') AS links
    FROM d LEFT JOIN spans ON d.row = spans.row GROUP BY d.row, d.doc_id
"""


ORACLES: dict[str, str] = {
    "op8_secrets": _SECRETS,
    "op2_embeddings": """
        WITH RECURSIVE wide AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        usable AS (
            SELECT * FROM wide
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
                AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(e, lambda x: x <> 0)) > 0
        ),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
        ),
        reach(node, root) AS (
            SELECT vec_id, vec_id FROM usable
            UNION
            SELECT links.b, reach.root FROM reach JOIN links ON reach.node = links.a AND reach.root < links.b
        ),
        roots AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
        numbers AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT w.vec_id, coalesce(n.n, 0) AS n_links, coalesce(r.component, w.vec_id) AS component_id,
            coalesce(r.component, w.vec_id) = w.vec_id AS kept
        FROM wide w LEFT JOIN roots r ON w.vec_id = r.node LEFT JOIN numbers n ON w.vec_id = n.a
    """,
    "op3_lines": """
        WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
        three AS (
            SELECT doc_id, pos, line, lead(line) OVER w AS line2, lead(line, 2) OVER w AS line3
            FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
        ),
        ranked AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, pos) AS n
            FROM three
            WHERE line3 IS NOT NULL AND NOT (trim(line, ' ') = '' AND trim(line2, ' ') = '' AND trim(line3, ' ') = '')
        ),
        gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM ranked WHERE n > 1),
        kept AS (
            SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n
            FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
        )
        SELECT s.doc_id,
            CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
            CASE WHEN s.text IS NULL THEN 0 ELSE len(s.ls) - coalesce(k.n, 0) END AS n_removed
        FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
    """,
    "op7_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        shingled AS (
            SELECT doc_id, list_distinct(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
            FROM words
        ),
        sizes AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM shingled),
        classes AS (SELECT min(doc_id) AS rep, n, s FROM sizes WHERE n > 0 GROUP BY n, s),
        items AS (SELECT rep, n, unnest(s) AS x FROM classes),
        shared AS (
            SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
            FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
            GROUP BY a.rep, b.rep
        ),
        links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(node, root) AS (
            SELECT rep, rep FROM classes
            UNION
            SELECT ways.b, reach.root FROM reach JOIN ways ON reach.node = ways.a AND reach.root < ways.b
        ),
        roots AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
        named AS (SELECT c.n, c.s, r.component FROM classes c JOIN roots r ON c.rep = r.node)
        SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles,
            coalesce(k.component, z.doc_id) AS component_id,
            coalesce(k.component, z.doc_id) = z.doc_id AS kept
        FROM sizes z LEFT JOIN named k ON z.n = k.n AND z.s = k.s
    """,
    "op10_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        sized AS (
            SELECT *,
                3 + 6 + 4
                + 2 * length(role) - length(regexp_replace(role, '[\[<\\]', '', 'g'))
                + 2 * length(text) - length(regexp_replace(text, '[\[<\\]', '', 'g')) AS chars
            FROM turns
        )
        SELECT conv_id,
            count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
