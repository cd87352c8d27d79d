from collections import defaultdict

from conftest import rows
from pyspark.sql import functions as F
from test_enrich import ROWS, entries, entry

from schemaloom.operators import browse, catalog, enrich, graph, joins, refs
from schemaloom.sources import sinks

LIBRARY = entry("library", tables=("reader", "loan", "branch"), columns=(
    (-1, "*"), (0, "reader_id"), (0, "branch_id"), (0, "joined"), (1, "loan_id"), (1, "branch_id"),
    (2, "branch_id"), (2, "Aisle")), fks=[(2, 6), (5, 6)])
TEXTS = [("library", "reader", 0, "reader_id", "", "the unique id")]


def library(spark, item=LIBRARY):
    return enrich.enriched_catalog(entries(spark, item), spark.createDataFrame(TEXTS, ROWS))


def log(spark, *sqls):
    """The texts as a log of one database, after a query of an unknown one."""
    asked = [(99, "elsewhere", "q", "SELECT 1 FROM reader")] + [(i, "library", f"q{i}", s) for i, s in enumerate(sqls)]
    return spark.createDataFrame(asked, "question_id long, db_id string, question string, SQL string")


def facts_of(spark, q):
    return sinks.staged(refs.query_facts(q), sinks.shared_folder(spark))


def nodes(spark, *sqls, item=LIBRARY):
    q = graph.in_catalog(log(spark, *sqls), library(spark, item))
    return rows(graph.gold_nodes(q, facts_of(spark, q), library(spark, item)), "question_id", "table_name")


READER_FK = "reader.branch_id references branch.branch_id."


LOAN_FK = "loan.branch_id references branch.branch_id."
# text -> edges, nodes
CASES = [
    # repeated joins give one edge, aliases are resolved
    ("SELECT l.loan_id FROM reader AS r JOIN branch AS b ON r.branch_id = b.branch_id JOIN loan AS l ON b.branch_id = "
     "l.branch_id WHERE EXISTS (SELECT 1 FROM reader AS r, branch AS b WHERE r.branch_id = b.branch_id)",
     [("reader", "branch_id", "branch", "branch_id", READER_FK),
      ("branch", "branch_id", "loan", "branch_id", LOAN_FK)], ["loan", "reader", "branch"]),
    # both directions are two edges with one text
    ("SELECT 1 FROM reader c JOIN branch d ON c.branch_id = d.branch_id AND d.branch_id = c.branch_id",
     [("reader", "branch_id", "branch", "branch_id", READER_FK),
      ("branch", "branch_id", "reader", "branch_id", READER_FK)], ["reader", "branch"]),
    # the alias of a derived table stays
    ("SELECT 1 FROM reader c JOIN (SELECT branch_id AS d FROM loan) AS T ON c.branch_id = T.d",
     [("reader", "branch_id", "T", "d", "")], ["loan", "reader"]),
    ("SELECT 1 FROM reader JOIN branch USING (branch_id)",
     [("reader", "branch_id", "branch", "branch_id", READER_FK)], ["reader", "branch"]),
    ("SELECT 1 FROM reader NATURAL JOIN loan",
     [("reader", "branch_id", "loan", "branch_id", "")], ["loan", "reader"]),
    # a natural join that repeats a stated edge adds nothing
    ("SELECT 1 FROM reader c NATURAL JOIN branch d WHERE c.branch_id = d.branch_id",
     [("reader", "branch_id", "branch", "branch_id", READER_FK)], ["reader", "branch"]),
    # spellings are separate nodes, unknown names none
    ("SELECT 1 FROM Reader, reader, nowhere", [], ["Reader", "reader"]),
    # a bare column adds its only owner, in its exact spelling
    ("SELECT Aisle FROM nowhere", [], ["branch"]),
    ("SELECT branch_id FROM nowhere", [], []),
    ("SELECT aisle FROM nowhere", [], []),
]


def test_edges_and_nodes(spark):
    c = library(spark)
    q = graph.in_catalog(log(spark, *[c[0] for c in CASES]), c)
    facts = facts_of(spark, q)
    edges, nodes = defaultdict(list), defaultdict(list)
    for k, *edge in rows(graph.gold_edges(facts, c), "question_id", *graph.FK_ENDS, "description"):
        edges[k].append(tuple(edge))
    for k, name in rows(graph.gold_nodes(q, facts, c), "question_id", "table_name"):
        nodes[k].append(name)
    assert [(edges[i], nodes[i]) for i in range(len(CASES))] == [(sorted(e), sorted(n)) for _, e, n in CASES]
    assert not edges[99] and not nodes[99]


def test_fallback_to_words_only_without_any_node(spark):
    item = entry("library", tables=("reader", "line item", "*"), columns=((-1, "*"), (0, "x"), (1, "x"), (2, "x")))
    assert nodes(spark, "SELECT 1 -- reader's Line Item", "SELECT 1 -- line-item readers", "SELECT 1 FROM reader --"
                 " line item", "", item=item) == [(0, "line item"), (0, "reader"), (2, "reader")]


def test_records_and_context_text(spark):
    q = log(spark, "SELECT 1 FROM reader c JOIN branch d ON c.branch_id = d.branch_id", "SELECT 1", None)
    q = graph.in_catalog(q, library(spark))
    done = graph.gold_records(q, facts_of(spark, q), library(spark))
    done = spark.createDataFrame(done.collect(), done.schema)
    got = done.orderBy("question_id").collect()
    assert got[0]["context_text"] == (
        "Table branch: branch_id, Aisle\nTable reader: reader_id: the unique id, branch_id, joined\n"
        f"Relationships:\nreader.branch_id → branch.branch_id ({READER_FK})")
    assert got[0]["question_en"] == "q0" and got[0]["question_ar"] == ""
    assert [(r["context_text"], r["gold_graph"]["nodes"]) for r in got[1:]] == [("", []), ("", [])]
    assert (0, "reader", "reader", "<b>reader_id</b> : the unique id<br/>branch_id<br/>joined") in rows(
        browse.view_nodes(done))
    assert rows(browse.view_links(done)) == [(0, "reader", "branch", "branch_id → branch_id", READER_FK)]


def test_neighbourhood_levels_are_the_nearest(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "vertex int")
    assert rows(graph.neighbourhood(v, e, 1)) == [(1, 0), (2, 1), (3, 2)]
    assert rows(graph.neighbourhood(v, e, 5)) == [(5, 0)]  # without an edge
    assert rows(graph.neighbourhood(v, e, 9)) == []


def test_neighbourhood_against_brute_force(spark):
    pairs = [(i % 7, (i * 5) % 23 + 7) for i in range(40)]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {3: 0}
    for v in near[3]:
        want.setdefault(v, 1)
    for v in near[3]:
        for w in near[v]:
            want.setdefault(w, 2)
    got = graph.neighbourhood(spark.range(30).selectExpr("cast(id as int) AS vertex"),
                              spark.createDataFrame(pairs, "src int, dst int"), 3)
    assert dict(rows(got)) == want


def test_filters_and_visible_part(spark):
    v = spark.createDataFrame([("a", "x", 1), ("b", "", 0), ("c", None, 2)], "vertex string, kind string, n int")
    e = spark.createDataFrame([("a", "b", "k"), ("b", "c", "m"), ("a", "c", "k")], "src string, dst string, kind string")
    assert rows(graph.vertices_with(v, "kind", ["x", ""])) == [("a",)]
    assert rows(graph.vertices_with(v, "n", ["0", "2"])) == [("c",)]
    assert rows(graph.ends_of_edges_with(e, "kind", ["m"])) == [("b",), ("c",)]
    assert rows(graph.visible_vertices(v, v.filter("vertex = 'c'")), "vertex") == [("c",)]
    assert rows(graph.visible_subgraph(e, v.filter("vertex <> 'c'"))) == [("a", "b", "k")]


def test_hot_keys_are_broadcast_and_no_row_is_lost(spark):
    """Two thirds of the log ask one database; all others of its keys meet the stored lookup, which is not shuffled."""
    asked = spark.range(60_000).select(
        F.col("id").alias("question_id"), F.when(F.col("id") % 3 < 2, "library").when(F.col("id") % 3 == 2, F.concat(F.lit("db"), F.col("id").cast("string"))).alias("db_id"),
        F.explode(F.array(F.lit("reader"), F.lit("branch"), F.lit(None))).alias("name_key"))
    c = catalog.plain_catalog(entries(spark, LIBRARY, entry("db5", tables=("reader",), columns=((-1, "*"), (0, "x")))))
    index = sinks.bucketed(catalog.table_names(c.tables, c.columns), ["db_id", "name_key"], sinks.shared_folder(spark))
    hot = joins.hot_keys(asked, ["db_id", "name_key"])
    assert rows(hot) == [("library", "branch"), ("library", "reader")]
    assert joins.hot_keys(asked, ["question_id"]) is None and joins.hot_keys(asked.limit(0), ["db_id"]) is None
    for how, n in (("inner", 80_001), ("left", 180_000), ("left_semi", 80_001)):
        joined = joins.split_lookup_join(asked, index, ["db_id", "name_key"], how)
        plain = joins.lookup_join(asked, index, ["db_id", "name_key"], how)
        assert joined.columns == plain.columns and joined.count() == n == plain.count()
        assert rows(joined.groupBy("db_id", "name_key").count()) == rows(plain.groupBy("db_id", "name_key").count())


def scans_below_an_exchange(plan, mark):
    """Scans whose line has `mark` and that an exchange other than a broadcast stands above, short of a join."""
    bad, path = [], []
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, line))
        if mark in line:
            for _, above in reversed(path):
                if "Join" in above or "BroadcastExchange" in above:
                    break
                if "Exchange" in above:
                    bad.append(line)
                    break
    return bad


def test_records_do_not_shuffle_the_stored_catalog(spark):
    c = graph.stored(library(spark))
    q = graph.in_catalog(log(spark, *[c[0] for c in CASES]), c)
    facts = facts_of(spark, q)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graph.gold_records(q, facts, c)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("spark_catalog.default.stored_") >= 5 and not scans_below_an_exchange(plan, "spark_catalog.default.stored_")
        assert rows(got, "question_id", "context_text") == rows(graph.gold_records(q, facts, library(spark)), "question_id", "context_text")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_table_called_like_the_most_frequent_word(spark, monkeypatch):
    """Tables meet texts on their rarest word; a name that is one frequent word is looked up by broadcast."""
    item = entry("library", tables=("select", "select rare", "rare thing", "never here", "line-item", "***"), columns=((-1, "*"), *((i, "x") for i in range(6))))
    sqls = ["SELECT 1 -- filler"] * 40 + ["SELECT rare", "rare select thing", "thing, rare", "SELECT line item line-item", "RARE  thing", "*** rare thing", ""]
    c = library(spark, item)
    q = log(spark, *sqls)
    q = q.where("db_id = 'library'")
    tokens = q.select("db_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("SQL"), F.lit(r"\w+"), F.lit(0)))).alias("word"))
    assert {(r["word"], r["table_name"]) for r in graph.rarest_words(tokens, c).collect()} == {
        ("select", "select"), ("rare", "select rare"), ("thing", "rare thing"), ("item", "line-item")}
    want = [(i, "select") for i in range(42)] + [(40, "select rare"), (43, "line-item"), (43, "select"), (45, "rare thing")]
    for rows_of_a_hot_key in (10_000, 10):
        monkeypatch.setattr(joins, "HOT_ROWS", rows_of_a_hot_key)
        got = graph.words_as_tables(q, c)
        assert sorted(rows(got, "question_id", "table_name")) == sorted(want)
    # no task gets more than its share of the frequent word
    many = spark.range(0, 40_000, 1, 16).select(F.col("id").alias("question_id"), F.lit("library").alias("db_id"), F.lit("SELECT 1 -- filler").alias("SQL"))
    monkeypatch.setattr(joins, "HOT_ROWS", 10_000)
    met = graph.words_as_tables(many, c).where("table_name = 'select'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in met) == 40_000 and max(r["n"] for r in met) <= 2 * 40_000 / 16


def test_neighbourhoods_of_any_depth(spark, monkeypatch):
    """Several origins, chains, a hub cut into lists, an origin without an edge and one that is not there."""
    pairs = [(i, i + 1) for i in range(8)] + [(100, 200 + i) for i in range(300)] + [(8, 100), (3, 3), (1, 0), (205, 4000)]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def reach(origin, degrees):
        level, front = {origin: 0}, [origin]
        for k in range(1, degrees + 1):
            front = [w for v in front for w in near[v] if w not in level and not level.update({w: k})]
        return level
    v = spark.createDataFrame([(i,) for i in (*range(9), 100, 205, 777)], "vertex int")
    e = spark.createDataFrame(pairs, "src int, dst int")
    origins = [0, 8, 205, 777, 999]
    o = spark.createDataFrame([(i,) for i in (*origins, 8)], "vertex int")
    for degrees in (0, 1, 3, 12):
        got = graph.neighbourhoods(v, e, o, degrees, chunk=7)
        assert rows(got) == sorted(((i, w, k) for i in origins[:-1] for w, k in reach(i, degrees).items()), key=repr)
    chunks, lists = graph.adjacency(e, 7)
    assert dict(rows(chunks))[100] == 43 and max(len(r["neighbours"]) for r in lists.collect()) < 40


def test_tasks_of_a_neighbourhood_follow_the_rows(spark, monkeypatch):
    """With two shuffle partitions, no task joins or groups more than its share, with hot hubs or without."""
    pairs = [(i % 40, 1000 + i % 300) for i in range(2400)] + [(7, 2000 + i) for i in range(300)]
    v = spark.createDataFrame([(i,) for i in range(40)], "vertex int")
    e = spark.createDataFrame([*pairs, (None, 1), (2, None)], "src int, dst int")
    o = spark.createDataFrame([(7,), (8,)], "vertex int")
    want = rows(graph.neighbourhoods(v, e, o, 2, chunk=7))
    assert len(want) > 300
    monkeypatch.setattr(joins, "ROWS", 100)
    for rows_of_a_hot_key, few in ((10_000, 0), (10, 50_000)):
        monkeypatch.setattr(joins, "HOT_ROWS", rows_of_a_hot_key)
        monkeypatch.setattr(graph, "FEW_LISTS", few)
        assert rows(graph.neighbourhoods(v, e, o, 2, chunk=7)) == want
        lists = graph.adjacency(e, 7)[1]
        assert len(lists.inputFiles()) > 10
        assert {(r["vertex"], b) for r in lists.collect() for b in r["neighbours"]} == {
            (a, b) for x, y in pairs + [(None, 1), (2, None)] for a, b in ((x, y), (y, x)) if a is not None and b is not None}


def test_a_database_without_tables_keeps_its_questions(spark):
    bare = entry("library", tables=(), columns=())
    q = graph.in_catalog(log(spark, "SELECT 1 FROM reader"), library(spark, bare))
    got = graph.gold_records(q, facts_of(spark, q), library(spark, bare)).collect()
    assert [(r["question_id"], r["context_text"]) for r in got] == [(0, "")]


def test_words_of_sql_are_no_columns(spark):
    item = entry("library", tables=("reader",), columns=((-1, "*"), (0, "end"), (0, "desc")))
    assert nodes(spark, "SELECT CASE WHEN 1 THEN 2 END FROM nowhere ORDER BY 1 DESC", item=item) == []


def test_the_columns_of_a_database_go_through_no_shuffle(spark):
    """Queries meet the lists of their database last. One key asked of two databases has the tables of both."""
    other = entry("other", tables=("reader",), columns=((-1, "*"), (0, "pages")))
    c = graph.stored(enrich.enriched_catalog(entries(spark, LIBRARY, other), spark.createDataFrame(TEXTS, ROWS)))
    q = spark.createDataFrame([(1, "library", "SELECT 1 FROM branch"), (2, "library", "SELECT 1 FROM reader"), (2, "other", "SELECT 1 FROM reader"),
                               (None, "other", "SELECT 1 FROM reader"), (3, "other", "SELECT 1")], "question_id long, db_id string, SQL string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graph.gold_records(q, facts_of(spark, q), c)
        plan = got._jdf.queryExecution().executedPlan().toString()
        free, path = [], []
        for line in plan.split("\n"):
            depth = len(line) - len(line.lstrip(" :+-"))
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, line))
            if "Scan" in line and "lists#" in line:
                free.append(not any("Exchange" in above for _, above in path))
        assert any(free)
        both = "Table reader: pages\nTable reader: reader_id: the unique id, branch_id, joined"
        assert rows(got, "question_id", "db_id", "context_text") == sorted([
            (1, "library", "Table branch: branch_id, Aisle"), (2, "library", both), (2, "other", both), (None, "other", ""), (3, "other", "")], key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_texts_are_dealt_out_by_their_number(spark):
    log = spark.range(0, 130, 1, 8)
    assert joins.spread(log, 10).rdd.getNumPartitions() == 13 and joins.spread(log, 10).count() == 130
    assert joins.spread(log).rdd.getNumPartitions() == 8 == joins.spread(log, 1000).rdd.getNumPartitions()


def test_records_over_written_graphs(spark):
    """Graphs are written once; records over them read neither log texts nor lookups again, and links no columns."""
    other = entry("other", tables=("reader",), columns=((-1, "*"), (0, "pages")))
    c = graph.stored(enrich.enriched_catalog(entries(spark, LIBRARY, other), spark.createDataFrame(TEXTS, ROWS)))
    alone = [(i, "library", s) for i, (s, _, _) in enumerate(CASES)] + [(None, "other", "SELECT 1 FROM reader")]
    for asked in (alone, [*alone, (1, "other", "SELECT 1 FROM reader")]):  # a key of two databases as well
        q = spark.createDataFrame(asked, "question_id long, db_id string, SQL string")
        facts = facts_of(spark, q)
        graphs = sinks.staged(graph.gold_graphs(q, facts, c), sinks.shared_folder(spark))
        done, want = graph.gold_records(q, facts, c, graphs=graphs), graph.gold_records(q, facts, c)
        assert rows(done) == rows(want) and len(rows(done)) == len(asked)
        plan = browse.view_links(done)._jdf.queryExecution().executedPlan().toString()
        assert "words#" not in plan and "lists#" not in plan
        assert rows(browse.view_links(done)) == rows(browse.view_links(want))


def test_words_of_a_table_name_are_read_once(spark):
    words = graph.table_words(library(spark))
    assert words._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert ("library", "branch", "branch", 1) in rows(words, "db_id", "word", "table_name", "n_words")
