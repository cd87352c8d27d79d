"""Schema entries, description rows, a query log and question records derived from the test tables.

Each document stands for one database, `db_<doc_id>`; its language picks one of four ways to write down the
schema of the seven relational tables. The sentences of the document are the rows of its description files.
Each order is one logged question of the database `db_<o_custkey>`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators.joins import TEXTS, spread

# Fixed values: (original table, readable table, [(original column, readable column), ...])
SCHEMA = [
    ("region", "region", [("r_regionkey", "region key"), ("r_name", "name")]),
    ("nation", "nation", [("n_nationkey", "nation key"), ("n_name", "name"), ("n_regionkey", "region key")]),
    ("customer", "customer", [("c_custkey", "customer key"), ("c_name", "name"), ("c_nationkey", "nation key"),
                              ("c_acctbal", "account balance"), ("c_mktsegment", "market segment")]),
    ("supplier", "supplier", [("s_suppkey", "supplier key"), ("s_name", "name"), ("s_nationkey", "nation key"),
                              ("s_acctbal", "account balance")]),
    ("part", "part", [("p_partkey", "part key"), ("p_name", "name"), ("p_brand", "brand"), ("p_type", "type"),
                      ("p_size", "size"), ("p_retailprice", "retail price")]),
    ("orders", "orders", [("o_orderkey", "order key"), ("o_custkey", "customer key"),
                          ("o_orderstatus", "order status"), ("o_totalprice", "total price"),
                          ("o_orderdate", "order date"), ("o_orderpriority", "order priority")]),
    ("lineitem", "line item", [("l_orderkey", "order key"), ("l_partkey", "part key"), ("l_suppkey", "supplier key"),
                               ("l_linenumber", "line number"), ("l_quantity", "quantity"),
                               ("l_extendedprice", "extended price"), ("l_discount", "discount"), ("l_tax", "tax"),
                               ("l_returnflag", "return flag"), ("l_linestatus", "line status"),
                               ("l_shipdate", "ship date")]),
]
LINKS = [("n_regionkey", "r_regionkey"), ("c_nationkey", "n_nationkey"), ("s_nationkey", "n_nationkey"),
         ("o_custkey", "c_custkey"), ("l_orderkey", "o_orderkey"), ("l_partkey", "p_partkey"),
         ("l_suppkey", "s_suppkey")]
# No pair, a pair with `*`, a pair outside the list.
BAD_LINKS = [[3], [0, 5], [2, 999]]

LANGS = ("en", "fr", "de", "es")


def _proper(name: str) -> str:
    return {"lineitem": "LineItem"}.get(name, name.capitalize())


@dataclass(frozen=True)
class Variant:
    """How one language writes the schema down; an absent list is None."""

    original_tables: list[str]
    canonical_tables: list[str] | None
    original_columns: list[tuple[int, str]]
    canonical_columns: list[tuple[int, str]] | None
    links: list[list[int]] = field(default_factory=list)


def variant(lang: str) -> Variant:
    """en: readable canonical names. fr: no canonical names. de: two tables share a canonical name, and the list
    is one short. es: tables in mixed case, columns without prefix, no canonical names."""
    tables = [t for t, _, _ in SCHEMA]
    plain = [(-1, "*")] + [(i, c) for i, (_, _, cols) in enumerate(SCHEMA) for c, _ in cols]
    readable = [(-1, "*")] + [(i, r) for i, (_, _, cols) in enumerate(SCHEMA) for _, r in cols]
    index = {name: i for i, (_, name) in enumerate(plain)}
    links = [[index[a], index[b]] for a, b in LINKS] + BAD_LINKS
    if lang == "en":
        return Variant(tables, [r for _, r, _ in SCHEMA], plain, readable, links)
    if lang == "de":
        shared = ["party" if t in ("customer", "supplier") else t for t in tables]
        return Variant(tables, shared[:-1], plain, None, links)
    if lang == "es":
        bare = [(i, n.split("_", 1)[-1]) for i, n in plain]
        return Variant([_proper(t) for t in tables], None, bare, None, links)
    return Variant(tables, None, plain, None, links)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_lang(value, kind: str) -> Column:
    """One literal per language, `value` giving nested lists or None."""
    cases = " ".join(f"WHEN '{lang}' THEN {_literal(value(variant(lang)))}" for lang in LANGS)
    return F.expr(f"CAST(CASE lang {cases} END AS {kind})")


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list | tuple):
        return f"array({', '.join(_literal(i) for i in x)})"
    return str(x) if isinstance(x, int) else f"'{x}'"


def _texts_of(items: list[tuple[int, str]] | None):
    return None if items is None else [(str(i), n) for i, n in items]


def db_name(c) -> Column:
    return F.concat(F.lit("db_"), F.col(c).cast("string"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schema entry per document."""
    names, pairs = "array<string>", "array<array<string>>"
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang")).select(
        db_name("doc_id").alias("db_id"),
        _by_lang(lambda v: v.canonical_tables, names).alias("table_names"),
        _by_lang(lambda v: v.original_tables, names).alias("table_names_original"),
        _by_lang(lambda v: _texts_of(v.canonical_columns), pairs).alias("column_names"),
        _by_lang(lambda v: _texts_of(v.original_columns), pairs).alias("column_names_original"),
        _by_lang(lambda v: v.links, "array<array<int>>").alias("foreign_keys"))


# Files of each database: the seven tables, a second spelling of one, and the shared canonical name.
FILES = [t for t, _, _ in SCHEMA] + ["Line Item", "party"]
FILE_COLUMNS = [cols for _, _, cols in SCHEMA] + [SCHEMA[6][2], SCHEMA[2][2]]


def description_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document as a row of one of its description files.

    Sentence i goes to file i mod 9, where it is row i div 9 and describes the column of that number, going round.
    Some rows name the column by its readable name only, some carry no text.
    """
    n_files = len(FILES)

    def nth(which: int) -> Column:
        names = f"get({_literal([[c[which] for c in cols] for cols in FILE_COLUMNS])}, f)"
        return F.expr(f"get({names}, row_no % size({names}))")

    sentences = (spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
                 .select(db_name("doc_id").alias("db_id"), F.posexplode(F.split("text", r"[.\n]+", -1)).alias("i", "s"))
                 .select("db_id", "i", "s", (F.col("i") % n_files).alias("f"),
                         F.expr(f"cast(i div {n_files} as int)").alias("row_no")))
    return sentences.select(
        "db_id", F.expr(f"get({_literal(FILES)}, f)").alias("file"), "row_no",
        F.when(F.col("i") % 5 == 3, "").when(F.col("i") % 5 == 1, F.upper(nth(0))).otherwise(nth(0))
        .alias("original_column_name"),
        nth(1).alias("column_name"),
        F.when(F.col("i") % 7 == 6, "").otherwise(F.col("s")).alias("column_description"))


def _texts() -> list[Column]:
    """The ways a logged query is written; literals come from the order."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    day, price = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey").cast("string")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return [
        c("SELECT T1.c_name FROM customer AS T1 INNER JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey WHERE "
          "T2.o_totalprice = (SELECT MAX(o_totalprice) FROM orders WHERE o_orderstatus = '", status, "')"),
        c("SELECT o_orderpriority, COUNT(*) FROM orders WHERE o_orderdate < '", day, "' GROUP BY o_orderpriority"),
        c("SELECT n.n_name FROM supplier s, nation n, region r WHERE s.s_nationkey = n.n_nationkey AND "
          "n.n_regionkey = r.r_regionkey AND r.r_name = 'FROM lineitem, JOIN part ON a.b = c.d ", priority, "'"),
        c("SELECT T.ok FROM (SELECT l_orderkey AS ok, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey) AS T "
          "INNER JOIN orders AS o ON T.ok = o.o_orderkey WHERE T.qty > ", price),
        c("SELECT b.name FROM nation AS a JOIN customer AS b USING (`nation key`, name) WHERE a.name <> '", status, "'"),
        c("SELECT r.name FROM nation n NATURAL JOIN region r WHERE r.name > '", priority, "'"),
        c("select * from Customer natural left join Orders where Orders.custkey = Customer.custkey and custkey > ",
          price),
        c("select C.\"c_name\", [o].o_orderdate from `Customer` as C inner join [ORDERS] as [o] on C.c_custkey = "
          "[o].o_custkey -- joined on part's key\n where o.o_orderstatus = '", status, "'"),
        c("SELECT p.p_name FROM main.part AS p JOIN lineitem AS l ON p.p_partkey = l.l_partkey AND "
          "l.l_partkey = p.p_partkey AND p.p_partkey = l.l_partkey /* twice = twice */ WHERE p.p_size > ", price),
        c("SELECT l_tax, tax FROM (SELECT * FROM unknown_table) WHERE l_tax > 0.0", price),
        c("SELECT 1 -- each line item and part of ", priority),
        c("SELECT o_orderkey, brand FROM orders, customer WHERE o_custkey = c_custkey AND o_orderdate = '", day, "'"),
        c("SELECT l.l_tax FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey + 0 WHERE l.l_discount + l.l_tax = "
          "p.p_size AND l.l_shipdate <> x.l_commitdate AND EXTRACT(year FROM l.l_shipdate) > ", price),
        c("SELECT T3.s_name FROM lineitem AS T1 INNER JOIN orders AS T2 ON T1.l_orderkey = T2.o_orderkey INNER JOIN "
          "supplier AS T3 ON T1.l_suppkey = T3.s_suppkey WHERE T1.l_quantity = (SELECT MAX(T1.l_quantity) FROM "
          "lineitem AS T1 INNER JOIN orders AS T2 ON T1.l_orderkey = T2.o_orderkey WHERE T2.o_orderpriority = '",
          priority, "')"),
        c("SELECT T1.\"order key\" FROM \"line item\" AS T1 JOIN \"orders\" T2 ON T1.\"order key\" = T2.\"order key\" "
          "WHERE T2.\"order status\" = '", status, "'"),
        c("WITH big AS (SELECT o_orderkey FROM orders WHERE o_totalprice > ", price, ") SELECT c.c_name, b.* FROM "
          "big b, customer c UNION SELECT s_name FROM supplier"),
        c("SELECT s.k, r_name FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > ", price,
          ") AS s, customer c, region WHERE s.k = c.c_custkey"),
        c("SELECT b.c_name FROM nation AS a JOIN (SELECT s_name FROM supplier WHERE s_acctbal > ", price,
          ") s ON a.n_name = s.s_name JOIN customer AS b USING (name)"),
        # no end of a literal, and none of a parenthesis
        c("SELECT c_name FROM customer WHERE c_mktsegment = 'open -- of nation and part ", priority),
        c("SELECT n_name FROM (SELECT n_name FROM nation JOIN region ON n_regionkey = r.r_regionkey WHERE n_name < '", status, "'"),
    ]


TEMPLATES = 20
BROKEN = (18, 19)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, db_id, question_en, question_ar, SQL): one logged query per order."""
    shape = F.col("o_orderkey") % TEMPLATES
    sql = None
    for i, text in enumerate(_texts()):
        sql = F.when(shape == i, text) if sql is None else sql.when(shape == i, text)
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return spread(orders, TEXTS).select(
        F.col("o_orderkey").alias("question_id"), db_name("o_custkey").alias("db_id"),
        F.concat(F.lit("Question "), F.col("o_orderkey").cast("string"), F.lit(" about "),
                 F.col("o_orderpriority")).alias("question_en"),
        F.lit(None).cast("string").alias("question_ar"), sql.alias("SQL"))


def raw_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question record per document, in old and new spelling, with labels as further fields."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kind = F.col("doc_id") % 3
    return (docs.join(labels, "doc_id", "left")
            .select(F.col("doc_id").alias("question_id"), F.col("source").alias("db_id"),
                    F.when(kind == 0, F.col("text")).alias("question"),
                    F.when(kind != 0, F.col("text")).alias("question_en"),
                    F.when(kind == 2, F.lit("")).alias("question_ar"),
                    F.when(kind == 0, F.col("lang")).alias("evidence"),
                    F.when(kind == 2, F.col("lang")).alias("evidence_en"),
                    F.when(kind == 2, F.lit("")).alias("evidence_ar"),
                    F.when(F.col("quality") == 1, "simple").when(F.col("quality") == 0, "moderate").alias("difficulty"),
                    "toxic"))
