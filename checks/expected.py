"""What the derived inputs are known to contain, as SQL for a side-by-side check.

The query shapes are listed here by hand, table by table and column by column; nothing is read out of
SQL text. The SQL joins these lists to the test tables.
"""

from __future__ import annotations

from checks.workload import FILE_COLUMNS, FILES, LANGS, LINKS, TEMPLATES, variant

# Fixed values per shape: tables in text order as (name, alias).
TABLES = {
    0: [("customer", "T1"), ("orders", "T2"), ("orders", "")],
    1: [("orders", "")],
    2: [("supplier", "s"), ("nation", "n"), ("region", "r")],
    3: [("lineitem", ""), ("orders", "o")],
    4: [("nation", "a"), ("customer", "b")],
    5: [("nation", "n"), ("region", "r")],
    6: [("Customer", ""), ("Orders", "")],
    7: [("Customer", "C"), ("ORDERS", "o")],
    8: [("part", "p"), ("lineitem", "l")],
    9: [("unknown_table", "")],
    10: [],
    11: [("orders", ""), ("customer", "")],
    12: [("lineitem", "l"), ("part", "p")],
    13: [("lineitem", "T1"), ("orders", "T2"), ("supplier", "T3"), ("lineitem", "T1"), ("orders", "T2")],
    14: [("line item", "T1"), ("orders", "T2")],
    15: [("orders", ""), ("big", "b"), ("customer", "c"), ("supplier", "")],
    16: [("orders", ""), ("customer", "c"), ("region", "")],
    17: [("nation", "a"), ("supplier", ""), ("customer", "b")],
    18: [], 19: [],
}
# Column equalities in text order.
PAIRS = {
    0: [("T1", "c_custkey", "T2", "o_custkey")],
    2: [("s", "s_nationkey", "n", "n_nationkey"), ("n", "n_regionkey", "r", "r_regionkey")],
    3: [("T", "ok", "o", "o_orderkey")],
    6: [("Orders", "custkey", "Customer", "custkey")],
    7: [("C", "c_custkey", "o", "o_custkey")],
    8: [("p", "p_partkey", "l", "l_partkey"), ("l", "l_partkey", "p", "p_partkey"),
        ("p", "p_partkey", "l", "l_partkey")],
    13: [("T1", "l_orderkey", "T2", "o_orderkey"), ("T1", "l_suppkey", "T3", "s_suppkey"),
         ("T1", "l_orderkey", "T2", "o_orderkey")],
    14: [("T1", "order key", "T2", "order key")],
    16: [("s", "k", "c", "c_custkey")],
    17: [("a", "n_name", "s", "s_name")],
}
# Joins by name: (left table, right table, listed columns).
BY_NAME = {4: [("nation", "customer", ["nation key", "name"])], 5: [("nation", "region", [])],
           6: [("Customer", "Orders", [])], 17: [("nation", "customer", ["name"])]}
# Other qualified columns, beyond those of the equalities.
QUALIFIED = {
    0: [("T1", "c_name"), ("T2", "o_totalprice")],
    2: [("n", "n_name"), ("r", "r_name")],
    3: [("T", "ok"), ("T", "qty")],
    4: [("b", "name"), ("a", "name")],
    5: [("r", "name")],
    7: [("C", "c_name"), ("o", "o_orderdate"), ("o", "o_orderstatus")],
    8: [("p", "p_name"), ("p", "p_size")],
    12: [("l", "l_tax"), ("l", "l_partkey"), ("p", "p_partkey"), ("l", "l_discount"), ("p", "p_size"),
         ("l", "l_shipdate"), ("x", "l_commitdate")],
    13: [("T3", "s_name"), ("T1", "l_quantity"), ("T2", "o_orderpriority")],
    14: [("T2", "order status")],
    15: [("c", "c_name"), ("b", "*")],
    17: [("b", "c_name")],
}
# What qualifiers stand for, by shape.
ALIASES = {
    0: {"customer": "customer", "T1": "customer", "orders": "orders", "T2": "orders"},
    1: {"orders": "orders"},
    2: {"supplier": "supplier", "s": "supplier", "nation": "nation", "n": "nation", "region": "region", "r": "region"},
    3: {"lineitem": "lineitem", "orders": "orders", "o": "orders"},
    4: {"nation": "nation", "a": "nation", "customer": "customer", "b": "customer"},
    5: {"nation": "nation", "n": "nation", "region": "region", "r": "region"},
    6: {"Customer": "Customer", "Orders": "Orders"},
    7: {"Customer": "Customer", "C": "Customer", "ORDERS": "ORDERS", "o": "ORDERS"},
    8: {"part": "part", "p": "part", "lineitem": "lineitem", "l": "lineitem"},
    9: {"unknown_table": "unknown_table"},
    10: {},
    11: {"orders": "orders", "customer": "customer"},
    12: {"lineitem": "lineitem", "l": "lineitem", "part": "part", "p": "part"},
    13: {"lineitem": "lineitem", "T1": "lineitem", "orders": "orders", "T2": "orders", "supplier": "supplier", "T3": "supplier"},
    14: {"line item": "line item", "T1": "line item", "orders": "orders", "T2": "orders"},
    15: {"orders": "orders", "big": "big", "b": "big", "customer": "customer", "c": "customer", "supplier": "supplier"},
    16: {"orders": "orders", "customer": "customer", "c": "customer", "region": "region"},
    17: {"nation": "nation", "a": "nation", "supplier": "supplier", "customer": "customer", "b": "customer"},
    18: {}, 19: {},
}
# Edges that the text states, by shape.
EDGES_OF = {
    0: [("customer", "c_custkey", "orders", "o_custkey")],
    2: [("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")],
    3: [("T", "ok", "orders", "o_orderkey")],
    4: [("nation", "nation key", "customer", "nation key"), ("nation", "name", "customer", "name")],
    6: [("Orders", "custkey", "Customer", "custkey")],
    7: [("Customer", "c_custkey", "ORDERS", "o_custkey")],
    8: [("part", "p_partkey", "lineitem", "l_partkey"), ("lineitem", "l_partkey", "part", "p_partkey")],
    13: [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")],
    14: [("line item", "order key", "orders", "order key")],
    16: [("s", "k", "customer", "c_custkey")],
    17: [("nation", "n_name", "s", "s_name"), ("nation", "name", "customer", "name")],
}
# Edges that a natural join implies, by language and shape.
NATURAL_OF = {
    ("en", 5): [("nation", "name", "region", "name"), ("nation", "region key", "region", "region key")],
    ("es", 6): [("Customer", "custkey", "Orders", "custkey")],
}
# Nodes by shape: the table as written, and its canonical name in English, French, German and Spanish entries; None
# where it is no node.
NODES_OF = {
    0: [("customer", "customer", "customer", "party", "Customer"), ("orders", "orders", "orders", "orders", "Orders")],
    1: [("orders", "orders", "orders", "orders", "Orders")],
    2: [("supplier", "supplier", "supplier", "party", "Supplier"), ("nation", "nation", "nation", "nation", "Nation"),
        ("region", "region", "region", "region", "Region")],
    3: [("lineitem", "line item", "lineitem", "lineitem", "LineItem"), ("orders", "orders", "orders", "orders", "Orders")],
    4: [("nation", "nation", "nation", "nation", "Nation"), ("customer", "customer", "customer", "party", "Customer")],
    5: [("nation", "nation", "nation", "nation", "Nation"), ("region", "region", "region", "region", "Region")],
    6: [("Customer", "customer", "customer", "party", "Customer"), ("Orders", "orders", "orders", "orders", "Orders")],
    7: [("Customer", "customer", "customer", "party", "Customer"), ("ORDERS", "orders", "orders", "orders", "Orders")],
    8: [("part", "part", "part", "part", "Part"), ("lineitem", "line item", "lineitem", "lineitem", "LineItem")],
    9: [("line item", "line item", None, None, None), ("lineitem", None, "lineitem", "lineitem", None),
        ("LineItem", None, None, None, "LineItem")],
    10: [("line item", "line item", None, None, None), ("part", "part", "part", "part", None), ("Part", None, None, None, "Part")],
    11: [("orders", "orders", "orders", "orders", "Orders"), ("customer", "customer", "customer", "party", "Customer"),
         ("part", "part", None, None, None), ("party", None, None, "party", None), ("Part", None, None, None, "Part")],
    12: [("lineitem", "line item", "lineitem", "lineitem", "LineItem"), ("part", "part", "part", "part", "Part")],
    13: [("lineitem", "line item", "lineitem", "lineitem", "LineItem"), ("orders", "orders", "orders", "orders", "Orders"),
         ("supplier", "supplier", "supplier", "party", "Supplier")],
    14: [("line item", "line item", None, None, None), ("orders", "orders", "orders", "orders", "Orders")],
    15: [("orders", "orders", "orders", "orders", "Orders"), ("customer", "customer", "customer", "party", "Customer"),
         ("supplier", "supplier", "supplier", "party", "Supplier"), ("party", None, None, "party", None)],
    16: [("orders", "orders", "orders", "orders", "Orders"), ("customer", "customer", "customer", "party", "Customer"),
         ("region", "region", "region", "region", "Region")],
    17: [("nation", "nation", "nation", "nation", "Nation"), ("supplier", "supplier", "supplier", "party", "Supplier"),
         ("customer", "customer", "customer", "party", "Customer"), ("party", None, None, "party", None)],
    # texts that cannot be read: tables whose names stand in them
    18: [("customer", "customer", "customer", None, None), ("nation", "nation", "nation", "nation", None), ("part", "part", "part", "part", None),
         ("Customer", None, None, None, "Customer"), ("Nation", None, None, None, "Nation"), ("Part", None, None, None, "Part")],
    19: [("nation", "nation", "nation", "nation", None), ("region", "region", "region", "region", None),
         ("Nation", None, None, None, "Nation"), ("Region", None, None, None, "Region")],
}


def lang_columns(lang: str) -> list[tuple]:
    """(col_idx, t_idx, original, canonical, table_original, table_canonical)"""
    v = variant(lang)
    canonical = v.canonical_columns or v.original_columns
    out = []
    for i, (t, name) in enumerate(v.original_columns):
        if t == -1:
            out.append((i, t, name, "*", "*", "*"))
        else:
            out.append((i, t, name, canonical[i][1], v.original_tables[t], lang_tables(lang)[t][2]))
    return out


# Original and canonical table names by language.
_PLAIN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
_PROPER = ["Region", "Nation", "Customer", "Supplier", "Part", "Orders", "LineItem"]
TABLES_OF = {"en": (_PLAIN, ["region", "nation", "customer", "supplier", "part", "orders", "line item"]), "fr": (_PLAIN, _PLAIN),
             "de": (_PLAIN, ["region", "nation", "party", "party", "part", "orders", "lineitem"]), "es": (_PROPER, _PROPER)}


def lang_tables(lang: str) -> list[tuple]:
    """(t_idx, original, canonical)"""
    return [(i, *names) for i, names in enumerate(zip(*TABLES_OF[lang]))]


def lang_links(lang: str) -> list[tuple]:
    """(fk_pos, child_idx, child_table, child_column, parent_idx, parent_table, parent_column)"""
    cols = {c[0]: c for c in lang_columns(lang)}
    out = []
    for pos, (a, b) in enumerate(variant(lang).links[:len(LINKS)]):
        out.append((pos, a, cols[a][4], cols[a][2], b, cols[b][4], cols[b][2]))
    return out


def _lit(x) -> str:
    if x is None:
        return "NULL"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_lit(x) for x in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def by_shape(name: str, columns: str, of: dict) -> str:
    """One row per entry of a shape, numbered in order."""
    rows = [(k, i, *entry) for k in range(TEMPLATES) for i, entry in enumerate(of.get(k, []))]
    return values(name, f"k, pos, {columns}", rows)


NORM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')".format

DOCS = "docs AS (SELECT 'db_' || doc_id AS db_id, lang, text FROM documents)"
V_TABLES = values("vt", "lang, t_idx, original, canonical", [(g, *r) for g in LANGS for r in lang_tables(g)])
V_COLUMNS = values("vc", "lang, col_idx, t_idx, original, canonical, table_original, table_canonical",
                   [(g, *r) for g in LANGS for r in lang_columns(g)])
V_LINKS = values("vf", "lang, fk_pos, child_idx, child_table, child_column, parent_idx, parent_table, parent_column",
                 [(g, *r) for g in LANGS for r in lang_links(g)])
SCHEMA = ", ".join([DOCS, V_TABLES, V_COLUMNS, V_LINKS])

ROWS = ", ".join([
    values("files", "f, file, n, slot, original, readable",
           [(f, FILES[f], len(cols), j, o, r) for f, cols in enumerate(FILE_COLUMNS) for j, (o, r) in enumerate(cols)]),
    "cut AS (SELECT db_id, regexp_split_to_array(text, '[.\\n]+') AS a FROM docs)",
    "sentences AS (SELECT db_id, unnest(a) AS s, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS i FROM cut)",
    """desc_rows AS (SELECT db_id, file, i // 9 AS row_no,
        CASE WHEN i % 5 = 3 THEN '' WHEN i % 5 = 1 THEN upper(original) ELSE original END AS original_column_name,
        readable AS column_name, CASE WHEN i % 7 = 6 THEN '' ELSE s END AS column_description
        FROM sentences JOIN files ON f = i % 9 AND slot = (i // 9) % n)""",
])
DESCRIPTIONS = ", ".join([
    ROWS,
    f"""keyed AS (SELECT db_id, file, {NORM('file')} AS table_key, row_no, which, col_key,
        regexp_replace(column_description, '^\\s+|\\s+$', '', 'g') AS t
        FROM (SELECT *, 0 AS which, {NORM('original_column_name')} AS col_key FROM desc_rows
              UNION ALL SELECT *, 1 AS which, {NORM('column_name')} AS col_key FROM desc_rows) WHERE col_key <> '')""",
    """last_file AS (SELECT db_id, table_key, max(file) AS file FROM keyed GROUP BY ALL)""",
    """dmap AS (SELECT db_id, table_key, col_key,
        coalesce(arg_min(t, row_no * 2 + which) FILTER (WHERE t <> ''), '') AS description
        FROM keyed JOIN last_file USING (db_id, table_key, file) GROUP BY ALL)""",
])
DESCRIBED = ", ".join([
    DESCRIPTIONS,
    f"""cols AS (SELECT docs.db_id, vc.* EXCLUDE (lang), CASE WHEN l.file IS NULL THEN {NORM('table_canonical')}
        ELSE {NORM('table_original')} END AS chosen FROM docs JOIN vc USING (lang)
        LEFT JOIN last_file l ON l.db_id = docs.db_id AND l.table_key = {NORM('table_original')})""",
    f"""described AS (SELECT c.* EXCLUDE (chosen), coalesce(m.description, '') AS description
        FROM cols c LEFT JOIN dmap m ON c.t_idx >= 0 AND m.db_id = c.db_id AND m.table_key = chosen
        AND m.col_key = {NORM('c.original')})""",
])
_HEAD = "child_table || '.' || child_column || ' references ' || parent_table || '.' || parent_column || '.'"
_TIDY = "rtrim(trim(regexp_replace({}, '\\s+', ' ', 'g')), '.') || '.'".format
FK = ", ".join([
    DESCRIBED,
    """fk_ends AS (SELECT docs.db_id, vf.* EXCLUDE (lang), c.description AS cd, p.description AS pd FROM docs
        JOIN vf USING (lang) JOIN described c ON c.db_id = docs.db_id AND c.col_idx = child_idx
        JOIN described p ON p.db_id = docs.db_id AND p.col_idx = parent_idx)""",
    f"""fks AS (SELECT db_id, fk_pos, child_table, child_column, parent_table, parent_column,
        cd AS child_description, pd AS parent_description,
        {_TIDY(f"{_HEAD} || CASE WHEN cd <> '' AND NOT contains({NORM('cd')}, {NORM('pd')}) THEN ' ' || cd "
               "WHEN pd <> '' THEN ' ' || pd ELSE '' END")} AS summary,
        'Foreign key linking ' || child_table || '.' || child_column || ' to ' || parent_table || '.' || parent_column
        AS usage FROM fk_ends)""",
])

LOG = (f"log AS (SELECT o_orderkey AS question_id, o_orderkey % {TEMPLATES} AS k, 'db_' || o_custkey AS db_id, "
       "'Question ' || o_orderkey || ' about ' || o_orderpriority AS question_en FROM orders)")
KNOWN = f"{LOG}, known AS (SELECT log.*, lang FROM log JOIN docs USING (db_id))"

V_EDGES = values("ve", "lang, k, pos, child_table, child_column, parent_table, parent_column",
                 [(g, k, i, *e) for g in LANGS for k, edges in EDGES_OF.items() for i, e in enumerate(edges)]
                 + [(g, k, len(EDGES_OF.get(k, [])), *e) for (g, k), edges in NATURAL_OF.items() for e in edges
                    if e not in EDGES_OF.get(k, [])])
V_NODES = values("vn", "lang, k, table_name, canonical",
                 [(g, k, n[0], n[i]) for i, g in enumerate(LANGS, 1) for k, names in NODES_OF.items() for n in names if n[i]])
EDGES = ", ".join([
    V_EDGES,
    """edges AS (SELECT question_id, e.db_id, pos, e.child_table, e.child_column, e.parent_table, e.parent_column,
        coalesce(f.summary, r.summary, '') AS description
        FROM (SELECT question_id, db_id, ve.* EXCLUDE (lang, k) FROM known JOIN ve USING (lang, k)) e
        LEFT JOIN fks f ON f.db_id = e.db_id AND f.child_table = e.child_table AND f.child_column = e.child_column
            AND f.parent_table = e.parent_table AND f.parent_column = e.parent_column
        LEFT JOIN fks r ON r.db_id = e.db_id AND r.parent_table = e.child_table AND r.parent_column = e.child_column
            AND r.child_table = e.parent_table AND r.child_column = e.parent_column)""",
])
NODES = ", ".join([
    V_NODES,
    "nodes AS (SELECT question_id, db_id, table_name, canonical FROM known JOIN vn USING (lang, k))",
])
NODE_COLUMNS = ", ".join([
    NODES,
    """node_columns AS (SELECT question_id, table_name, CAST(row_number() OVER (PARTITION BY question_id, table_name
        ORDER BY col_idx) - 1 AS INTEGER) AS col_pos, d.canonical AS column_name, description
        FROM nodes n JOIN described d ON d.db_id = n.db_id AND d.table_canonical = n.canonical AND t_idx >= 0)""",
])
CONTEXT = ", ".join([
    NODE_COLUMNS, EDGES,
    """node_lines AS (SELECT question_id, table_name, 'Table ' || table_name || ': ' || string_agg(CASE WHEN
        description = '' THEN column_name ELSE column_name || ': ' || description END, ', ' ORDER BY col_pos) AS line
        FROM node_columns GROUP BY question_id, table_name)""",
    """node_text AS (SELECT question_id, string_agg(line, chr(10) ORDER BY table_name) AS t FROM node_lines GROUP BY question_id)""",
    """edge_text AS (SELECT question_id, 'Relationships:' || chr(10) || string_agg(child_table || '.' || child_column ||
        ' → ' || parent_table || '.' || parent_column || CASE WHEN description = '' THEN '' ELSE ' (' || description ||
        ')' END, chr(10) ORDER BY pos, child_table, child_column, parent_table, parent_column) AS t
        FROM edges GROUP BY question_id)""",
    """context AS (SELECT question_id, db_id, question_en, concat_ws(chr(10), n.t, e.t) AS context_text
        FROM known LEFT JOIN node_text n USING (question_id) LEFT JOIN edge_text e USING (question_id))""",
])


def sql(*parts: str, select: str) -> str:
    return "WITH " + ", ".join(parts) + " " + select
