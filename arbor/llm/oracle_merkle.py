"""DuckDB text of the Merkle query, for up to 16^5 leaves a source and 16^3
sources."""

from __future__ import annotations


def _field(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32 of an ASCII text: a step for each byte and eight for its bits.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295::BIGINT)"""


def _tree(name: str, first: str, levels: int) -> list[str]:
    """Levels of (g, pos, h): g is the tree, and a finished tree has one node."""
    out = [f"{name}0 AS ({first})"]
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (
          SELECT g, pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h
          FROM {name}{k} WHERE g IN (SELECT g FROM {name}{k} GROUP BY g HAVING count(*) > 1) GROUP BY g, pos // 16)""")
    return out


def _sides(name: str, k: int) -> str:
    """Left and right siblings of each node, if its tree has more than one."""
    return f"""{name}s{k} AS (
      SELECT a.g, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
             coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
      FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.pos // 16 = b.pos // 16
      WHERE a.g IN (SELECT g FROM {name}{k} GROUP BY g HAVING count(*) > 1)
      GROUP BY a.g, a.pos)"""


def text(levels: int = 5, upper: int = 3) -> str:
    ctes = [f"""d AS (
      SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {_leaf("text")} AS leaf,
             {_leaf("CASE WHEN " + _CRC + " % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                    "'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS seen
      FROM documents)""",
            "p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)"]
    ctes += _tree("t", "SELECT g, pos, leaf AS h FROM p", levels)
    ctes.append("subroots AS (" + " UNION ALL ".join(
        f"SELECT g, any_value(h) AS h FROM t{k} GROUP BY g HAVING count(*) = 1" for k in range(levels + 1)) + ")")
    ctes += _tree("u", "SELECT 0 AS g, g AS pos, h FROM subroots", upper)
    ctes.append("root AS (" + " UNION ALL ".join(
        f"SELECT any_value(h) AS root FROM u{k} GROUP BY g HAVING count(*) = 1" for k in range(upper + 1)) + ")")
    ctes += [_sides("t", k) for k in range(levels)] + [_sides("u", k) for k in range(upper)]
    joins, steps = [], []
    for k in range(levels):
        joins.append(f"LEFT JOIN ts{k} ON ts{k}.g = p.g AND ts{k}.pos = p.pos // {16 ** k}")
        steps.append(f"ts{k}")
    for k in range(upper):
        joins.append(f"LEFT JOIN us{k} ON us{k}.pos = p.g // {16 ** k}")
        steps.append(f"us{k}")
    proof = " || ".join(f"coalesce({s}.l || {s}.r, '')" for s in steps)
    ctes.append(f"""f0 AS (SELECT p.doc_id, p.g, p.leaf, p.seen AS h, sha256({proof}) AS proof_sha256,
      {", ".join(f"{s}.l AS {s}l, {s}.r AS {s}r" for s in steps)} FROM p {" ".join(joins)})""")
    for k, s in enumerate(steps):
        ctes.append(f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN {s}l IS NULL THEN h "
                    f"ELSE sha256({s}l || h || {s}r) END AS h) FROM f{k})")
    return ("WITH " + ",\n".join(ctes) + f"""
      SELECT doc_id, leaf, subroots.h AS subroot, root, proof_sha256, f.h AS folded_root, f.h = root AS verified
      FROM f{len(steps)} f JOIN subroots USING (g) CROSS JOIN root""")
