"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _decontamination() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
-- every window of every item, by its number of words
win AS MATERIALIZED (
    SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
hit AS MATERIALIZED (
    SELECT p.rid, p.i, p.k, win.item
    FROM (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
          FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))) p
    JOIN win ON win.k = p.k AND win.s = p.s),
covered AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT rid, i, k FROM hit)) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""


def _tree(name: str, key: str, levels: int) -> list[str]:
    """CTEs name0.. (key, pos, digest, n): a node of a tree of n nodes on its level; name0 is given."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS MATERIALIZED (
    SELECT {key}, pos, digest, count(*) OVER (PARTITION BY {key}) AS n
    FROM (SELECT {key}, CASE WHEN n > 1 THEN pos // 16 ELSE pos END AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE max(digest) END AS digest
          FROM {name}{k} GROUP BY {key}, n, CASE WHEN n > 1 THEN pos // 16 ELSE pos END))""")
    return out


def _steps(tree: str, start: str, key: str, pos: str, levels: int) -> tuple[list[str], str]:
    """CTEs which fold `shown` and add siblings to `beside` level by level; pos is taken from the column `pos`."""
    out, last = [], start
    for k in range(levels):
        node = f"{tree}{k}"
        here = f"{pos} // {16**k}"
        out.append(f"""{last}_{tree}{k} AS MATERIALIZED (
    SELECT x.* REPLACE (CASE WHEN r.n > 1 THEN sha256(substr(r.run, 1, 64 * ({here} % 16)) || x.shown || substr(r.run, 64 * ({here} % 16) + 65)) ELSE x.shown END AS shown,
                        CASE WHEN r.n > 1 THEN x.beside || substr(r.run, 1, 64 * ({here} % 16)) || substr(r.run, 64 * ({here} % 16) + 65) ELSE x.beside END AS beside)
    FROM {last} x LEFT JOIN (SELECT {key} AS k, pos // 16 AS p, max(n) AS n, string_agg(digest, '' ORDER BY pos) AS run FROM {node} GROUP BY ALL) r ON r.k IS NOT DISTINCT FROM x.{key} AND r.p = x.{here} // 16)""")
        last = f"{last}_{tree}{k}"
    return out, last


def _manifest(levels: int = 7) -> str:
    """Unrolled to 16^7 leaves of a source and as many sources."""
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars")) + f" || {field(text)})"
    # crc32 of the decimal digits, bit by bit: DuckDB has none of its own
    crc = "list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: " + "list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END))"
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    inner, last = _steps("t", "leaves", "source", "pos", levels)
    outer, end = _steps("s", "beyond", "one", "place", levels)
    parts = [
        f"""rows AS MATERIALIZED (
    SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND xor({crc}, CAST(4294967295 AS BIGINT)) % 5 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS shown FROM documents)""",
        "leaves AS MATERIALIZED (SELECT doc_id, source, leaf, shown, '' AS beside, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows)",
        "t0 AS MATERIALIZED (SELECT source, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        *_tree("t", "source", levels),
        f"s0 AS MATERIALIZED (SELECT 1 AS one, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, digest, count(*) OVER () AS n, source FROM t{levels})",
        *_tree("s", "one", levels),
        *inner,
        f"beyond AS MATERIALIZED (SELECT x.doc_id, x.leaf, x.shown, x.beside, 1 AS one, s0.pos AS place, s0.digest AS subroot FROM {last} x JOIN s0 ON s0.source IS NOT DISTINCT FROM x.source)",
        *outer,
    ]
    return f"WITH {', '.join(parts)}\nSELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, shown AS folded_root, shown = root AS verified FROM {end}, (SELECT digest AS root FROM s{levels})"


def _clustering(rounds: int = 5) -> str:
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND abs(CAST(x AS DOUBLE) * 256) < 134217728)) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept) ORDER BY h NULLS LAST, v LIMIT 40)",
    ]
    for r in range(rounds + 1):
        parts.append(f"near{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d, k)) AS m FROM (SELECT rid, vec_id, kept.v, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c{r}.v[i]) * (kept.v[i] - c{r}.v[i]))) AS BIGINT) AS d FROM kept, c{r}) GROUP BY rid)")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
    SELECT c.k, coalesce(u.v, c.v) AS v FROM c{r} c LEFT JOIN (
        SELECT k, list(mean ORDER BY i) AS v FROM (
            SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS mean FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(range(1, 65)) AS i, unnest(v) AS x FROM near{r}) GROUP BY k, i)) GROUP BY k) u ON u.k = c.k)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM near{rounds} JOIN c{rounds} ON c{rounds}.k = m.k"""


ORACLE_SQL = {"op11_benchmark_decontamination": _decontamination(), "op12_merkle_manifest": _manifest(), "op13_centroid_clustering": _clustering()}
