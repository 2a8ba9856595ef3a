"""DuckDB SQL for the rows of ``manifest.verify`` over ``documents``."""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Bit by bit over the digits of the id.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _climb(name: str, start: str) -> str:
    """Level by level upwards: the parents' preimages are their children's digests one after the other."""
    return f"""{name} AS ({start}
    UNION ALL SELECT k + 1, tree, parent, sha256(pre), pre, (n + 15) // 16 FROM (
      SELECT k, tree, node // 16 AS parent, string_agg(hash, '' ORDER BY node) AS pre, max(n) AS n FROM {name} WHERE n > 1 GROUP BY k, tree, parent))"""


def _walk(name: str, start: str, levels: str) -> str:
    """From a node to its tree's last one: the digest put into each preimage, and the siblings left of it."""
    cut = "left(p.pre, 64 * (w.node % 16)){}substr(p.pre, 64 * (w.node % 16) + 65)"
    return f"""{name} AS ({start}
    UNION ALL SELECT w.r, w.k + 1, w.tree, w.node // 16, sha256({cut.format(" || w.now || ")}), w.proof || {cut.format(" || ")}
    FROM {name} w JOIN {levels} p ON p.tree = w.tree AND p.k = w.k + 1 AND p.node = w.node // 16)"""


SQL = f"""WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS r
  FROM (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(_LOW)} END AS tampered FROM documents)),
{_climb("lv", "SELECT 0 AS k, tree, node, leaf AS hash, '' AS pre, n FROM d")},
tops AS (SELECT tree, hash FROM lv WHERE n = 1),
{_climb("ov", "SELECT 0 AS k, 0 AS tree, tree AS node, hash, '' AS pre, (SELECT count(*) FROM tops) AS n FROM tops")},
{_walk("wi", "SELECT r, 0 AS k, tree, node, coalesce(tampered, leaf) AS now, '' AS proof FROM d", "lv")},
inner_end AS (SELECT r, arg_max(tree, k) AS tree, arg_max(now, k) AS now, arg_max(proof, k) AS proof FROM wi GROUP BY r),
{_walk("wo", "SELECT r, 0 AS k, 0 AS tree, tree AS node, now, proof FROM inner_end", "ov")},
outer_end AS (SELECT r, arg_max(now, k) AS now, arg_max(proof, k) AS proof FROM wo GROUP BY r)
SELECT doc_id, leaf, t.hash AS subroot, o.hash AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = o.hash AS verified
FROM d JOIN tops t USING (tree) JOIN outer_end USING (r), (SELECT hash FROM ov WHERE n = 1) o"""
