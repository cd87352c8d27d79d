"""Join graphs of logged queries, resolved against a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.sqltext import let, text_tokens
from schemaloom.functions.text import edge_line, filled, first_filled, labelled, whole_word
from schemaloom.operators import catalog as cat
from schemaloom.operators import joins
from schemaloom.operators.catalog import Catalog
from schemaloom.operators.enrich import FK_ENDS
from schemaloom.sources import sinks


def in_catalog(log: DataFrame, catalog: Catalog) -> DataFrame:
    """Questions whose database the catalog knows. Done once, before their text is read; the functions below expect it."""
    return catalog.lookup(log, catalog.kept("databases", lambda: catalog.databases), ["db_id"], "left_semi")


def stored(catalog: Catalog, folder: str | None = None) -> Catalog:
    """The catalog with what the steps below look up stored in buckets, so that joining a log to it shuffles the log alone."""
    folder = folder or sinks.shared_folder(catalog.databases.sparkSession)
    return catalog.stored(lambda table, keys, name: sinks.bucketed(table, keys, f"{folder}/{name}", keys == ["db_id"]), lookups(catalog))


def lookups(catalog: Catalog) -> dict[str, tuple[DataFrame, list[str]]]:
    """What the steps below look up, with the keys they look it up by: what `Catalog.stored` stores."""
    return {"databases": (catalog.databases.distinct(), ["db_id"]),
            "fk_texts": (fk_lookup(catalog), ["db_id"]),
            "names": (name_index(catalog), ["db_id"]),
            "table_words": (table_words(catalog), ["db_id", "word"]),
            "column_names": (column_names(catalog), ["db_id"]),
            "column_lists": (catalog.lists_by_db(), ["db_id"])}


def fk_lookup(catalog: Catalog) -> DataFrame:
    """(db_id, texts): a database's texts by the four names, in both directions; the direction as declared comes first."""
    def facing(turn: int, *names: str) -> DataFrame:
        return catalog.fk_texts.select(
            "db_id", *[F.col(n).alias(e) for n, e in zip(names, FK_ENDS)],
            F.when(F.lit(turn == 0), F.col("description")).alias("forward"),
            F.when(F.lit(turn == 1), F.col("description")).alias("backward"))

    child, child_col, parent, parent_col = FK_ENDS
    both = facing(0, child, child_col, parent, parent_col).unionByName(
        facing(1, parent, parent_col, child, child_col)).dropna(subset=FK_ENDS).repartition("db_id")
    texts = both.groupBy("db_id", *FK_ENDS).agg(first_filled(F.max("forward"), F.max("backward")).alias("description"))
    return cat.by_db(texts.select("db_id", F.struct(*FK_ENDS).alias("ends"), "description"), "ends", F.col("description"), "texts")


def column_names(catalog: Catalog) -> DataFrame:
    """(db_id, column_names): the distinct column names of each canonical table, by its name."""
    names = (catalog.columns.filter("t_idx >= 0").groupBy("db_id", F.col("table_canonical").alias("table_name"))
             .agg(F.collect_set("canonical").alias("names")))
    return cat.by_db(names, "table_name", F.col("names"), "column_names")


def gold_edges(facts: DataFrame, catalog: Catalog, key: str = "question_id") -> DataFrame:
    """(key, db_id, pos, four names, description): the equality joins of each query, each once.

    Edges point the way they are written. What the text states needs the catalog for its descriptions only; a NATURAL join has
    an edge for each column name that both tables have, unless the text states it. Queries meet the catalog by database,
    once; all else is done inside the row.
    """
    keep = [key, "db_id"]
    known = facts.select(*keep, "edges", F.when(F.col("maybe_natural"), F.col("natural")).alias("natural"))
    for name, make in (("column_names", column_names), ("fk_texts", fk_lookup)):
        known = catalog.lookup(known, catalog.kept(name, lambda: make(catalog)), ["db_id"])  # noqa: B023
    shared = lambda j: F.array_intersect(*[F.try_element_at("column_names", j[f"{side}_table"]) for side in ("left", "right")])
    edge = lambda j, name: F.struct(j["left_table"].alias("child_table"), name.alias("child_column"),
                                    j["right_table"].alias("parent_table"), name.alias("parent_column"))
    placed = lambda e, pos: F.struct(pos.alias("pos"), e.alias("e"))
    none = F.array().cast("array<struct<child_table:string,child_column:string,parent_table:string,parent_column:string>>")
    implied = F.flatten(F.transform(F.array_distinct("natural"), lambda j: F.coalesce(F.transform(shared(j), lambda n: edge(j, n)), none)))
    whole = F.filter("edges", lambda e: (e["child_table"] != "") & (e["parent_table"] != ""))
    stated = F.transform(whole, lambda e, i: placed(e, i))
    unsaid = F.transform(F.filter(F.coalesce(implied, none), lambda e: ~F.array_contains("edges", e)), lambda e: placed(e, F.size("edges")))
    found = known.select(*keep, "texts", F.explode(F.concat(stated, unsaid)).alias("e")).select(*keep, "texts", "e.pos", "e.e.*")
    return found.select(*keep, "pos", *FK_ENDS, filled(F.try_element_at("texts", F.struct(*FK_ENDS))).alias("description"))


def name_index(catalog: Catalog) -> DataFrame:
    """(db_id, tables, owners): the candidates of each table name and the owner of each uniquely owned column name; a row per database."""
    names = cat.table_names(catalog.tables, catalog.columns)
    owners = cat.unique_owners(catalog.columns)
    return (cat.by_db(names, "name_key", F.col("candidates"), "tables")
            .join(cat.by_db(owners, "name", F.col("owner"), "owners").hint("merge"), "db_id", "full"))


def resolve_names(facts: DataFrame, catalog: Catalog, key: str = "question_id") -> DataFrame:
    """(key, db_id, table_name, canonical): tables a query names, refers to, or implies by a bare column.

    `table_name` is the name as written, so two spellings are two rows. Rows come out by key.
    """
    known = catalog.lookup(facts.select(key, "db_id", "names", "words"), catalog.kept("names", lambda: name_index(catalog)), ["db_id"], "inner")
    item = lambda name, canonical: F.struct(name.alias("table_name"), canonical.alias("canonical"))
    named = F.transform("names", lambda n: item(n, cat.canonical_name(n, F.try_element_at("tables", F.lower(n)))))
    owned = F.transform(F.transform("words", lambda w: F.try_element_at("owners", w)), lambda o: item(o, o))
    hits = F.array_distinct(F.filter(F.concat(named, owned), lambda i: i["canonical"].isNotNull()))
    return (known.select(key, "db_id", F.explode(hits).alias("i")).select(key, "db_id", "i.*").repartition(key)
            .groupBy(key, "db_id", "table_name").agg(F.min("canonical").alias("canonical")))


def table_words(catalog: Catalog) -> DataFrame:
    """(db_id, word, table_name, n_words): each word of the canonical table names. A name without a word has ''."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("table_name"), F.lit(r"(?U)\w+"), F.lit(0)))
    named = catalog.columns.filter("t_idx >= 0").select("db_id", F.col("table_canonical").alias("table_name")).distinct()
    listed = named.withColumn("words", let(words, lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(F.lit("")))))
    # through an expression, below which Spark pushes no test of its own that would read the name again
    return listed.select("db_id", F.explode(F.transform("words", lambda w: w)).alias("word"), "table_name", F.size("words").alias("n_words"))


def rarest_words(tokens: DataFrame, catalog: Catalog) -> DataFrame:
    """(db_id, word, table_name, n): each table under the one of its words that the fewest texts have; n is how many do.

    tokens: (db_id, word), each word once per text. A table of which some word is in no text of its database is in none.
    """
    counts = tokens.groupBy("db_id", "word").agg(F.count("*").alias("n"))
    seen = counts.join(catalog.kept("table_words", lambda: table_words(catalog)), ["db_id", "word"])
    return (seen.groupBy("db_id", "table_name")
            .agg(F.min(F.struct("n", "word")).alias("r"), F.count("*").alias("found"), F.max("n_words").alias("n_words"))
            .where("found = n_words").select("db_id", "r.word", "table_name", "r.n"))


#: Tables that are broadcast for words that are in very many texts.
FEW_TABLES = 100_000


def words_as_tables(log: DataFrame, catalog: Catalog, key: str = "question_id", sql: str = "SQL") -> DataFrame:
    """(key, db_id, table_name, canonical): schema tables whose name stands in the text as whole words.

    Text and table meet on the word of the table's name that the fewest texts have, so that a frequent word brings only the
    tables that are called nothing else. Names of several words are then looked for in the text. Words that are in very many
    texts even so, which the counts tell, are looked up by broadcast if they have `FEW_TABLES` at most.
    """
    tokens = log.select(key, "db_id", F.explode(F.concat(text_tokens(F.col(sql)), F.array(F.lit("")))).alias("word"))
    tables = sinks.staged(rarest_words(tokens, catalog), sinks.shared_folder(log.sparkSession))
    total = tables.agg(F.sum("n")).first()[0] or 0
    frequent = tables.where(F.col("n") >= max(joins.HOT_ROWS, total * joins.HOT_SHARE)).select("db_id", "word")
    many = frequent.limit(FEW_TABLES + 1).count()
    tables = tables.drop("n")
    met = (joins.split_lookup_join(tokens, tables, ["db_id", "word"], "inner", frequent.distinct()) if 0 < many <= FEW_TABLES
           else joins.lookup_join(tokens, tables, ["db_id", "word"], "inner"))
    single = F.lower("table_name") == F.col("word")
    texts = log.select(key, F.lower(sql).alias("text"))
    longer = (met.filter(~single).join(texts, key)
              .filter(whole_word(F.col("text"), F.lower("table_name"))).drop("text"))
    return (met.filter(single).unionByName(longer)
            .select(key, "db_id", "table_name", F.col("table_name").alias("canonical")))


def gold_nodes(log: DataFrame, facts: DataFrame, catalog: Catalog, key: str = "question_id",
               sql: str = "SQL") -> DataFrame:
    """(key, db_id, table_name, canonical): the tables of each query's graph.

    Queries whose text gives no table at all fall back to schema tables named anywhere in it.
    """
    keep = lambda df: sinks.staged(df, sinks.shared_folder(log.sparkSession))
    named = keep(resolve_names(facts, catalog, key))  # for both uses of it, here and in what is returned
    found = named.groupBy(key).agg(F.max("canonical").alias("some")).select(key, "some")
    left_over = keep(log.select(key, "db_id", sql).join(found, key, "left").filter("some is null").drop("some"))
    return named.unionByName(words_as_tables(left_over, catalog, key, sql))


_NO_COLUMNS = "array<struct<name:string,description:string>>"


def _listed(table: str = "canonical") -> Column:
    """The columns of a canonical table out of its database's `lists`."""
    return F.try_element_at("lists", F.col(table))


def _with_lists(rows: DataFrame, catalog: Catalog, hot: DataFrame | None = None) -> DataFrame:
    """`rows` with the `lists` of their database, which are shuffled with nothing. hot: databases that very many rows share."""
    lists = catalog.kept("column_lists", catalog.lists_by_db)
    return joins.lookup_join(rows, lists, ["db_id"]) if hot is None else joins.split_lookup_join(rows, lists, ["db_id"], hot=hot)


def node_columns(nodes: DataFrame, catalog: Catalog, key: str = "question_id") -> DataFrame:
    """(key, table_name, col_pos, column_name, description): nodes with their columns, one row each."""
    nodes = sinks.staged(nodes, sinks.shared_folder(nodes.sparkSession))
    lists = _with_lists(nodes, catalog, joins.hot_keys(nodes, ["db_id"]))
    return (lists.select(key, "table_name", F.posexplode_outer(_listed()).alias("col_pos", "c"))
            .select(key, "table_name", "col_pos", F.col("c.name").alias("column_name"), "c.description"))


def plain_graphs(nodes: DataFrame, edges: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, node_db, several, named, edges): one graph per query with the names of its tables, not yet their columns.

    `several`: the rows of the key are of more than one database; then `node_db` is one of them.
    """
    named = nodes.groupBy(key).agg(F.collect_list(F.struct("db_id", "table_name", "canonical")).alias("named"),
                                   F.min("db_id").alias("node_db"), (F.min("db_id") != F.max("db_id")).alias("several"))
    edge = F.struct("pos", *FK_ENDS, "description")
    edge_lists = (edges.groupBy(key).agg(F.sort_array(F.collect_list(edge)).alias("e"))
                  .select(key, F.transform("e", lambda e: F.struct(
                      *[e[f].alias(f) for f in [*FK_ENDS, "description"]])).alias("edges")))
    return named.join(edge_lists, key, "full")


def gold_graphs(log: DataFrame, facts: DataFrame, catalog: Catalog, key: str = "question_id", sql: str = "SQL") -> DataFrame:
    """`plain_graphs` of the queries of a log. Jobs that use them several times write them first: they are narrow."""
    return plain_graphs(gold_nodes(log, facts, catalog, key, sql), gold_edges(facts, catalog, key), key)


def with_columns(rows: DataFrame, graphs: DataFrame, catalog: Catalog, key: str = "question_id", hot: DataFrame | None = None,
                 several: bool = True) -> DataFrame:
    """`rows` (key, ...) with `nodes`, the tables of their graph and the columns of these, and `edges`.

    Rows and graphs meet by key while they are narrow; the columns of a database come last and go through no shuffle. Only
    for a key with rows of several databases are the lists put together by key. several: may there be such a key?
    """
    none = F.array().cast(_NO_COLUMNS)
    node = lambda table, columns: F.struct(table.alias("table_name"), F.coalesce(columns, none).alias("columns"))
    out = [*[F.col("_db").alias(c) if c == "db_id" else F.col(c) for c in rows.columns], "nodes", "edges"]
    met = rows.withColumnRenamed("db_id", "_db").join(graphs, key, "left")
    one = _with_lists((met.filter(~F.coalesce("several", F.lit(False))) if several else met).withColumnRenamed("node_db", "db_id"), catalog, hot)
    nodes = F.sort_array(F.transform("named", lambda n: node(n["table_name"], F.try_element_at("lists", n["canonical"]))))
    one = one.withColumn("nodes", nodes).select(*out)
    if not several:
        return one
    mixed = graphs.filter("several").select(key, F.explode(F.transform("named", lambda n: n)).alias("n")).select(key, "n.*")
    lists = (_with_lists(mixed, catalog, hot).groupBy(key)
             .agg(F.sort_array(F.collect_list(node(F.col("table_name"), _listed()))).alias("nodes")))
    more = met.filter("several").join(lists, key)
    return one.unionByName(more.select(*out))


def context_text(nodes, edges):
    """One line per node, then the relationships if there are any."""
    node_lines = F.transform(nodes, lambda n: F.concat(
        F.lit("Table "), n["table_name"], F.lit(": "),
        F.array_join(F.transform(n["columns"], lambda c: labelled(c["name"], c["description"])), ", ")))
    edge_lines = F.transform(edges, lambda e: edge_line(*[e[f] for f in FK_ENDS], e["description"]))
    head = F.when(F.size(edge_lines) > 0, F.array(F.lit("Relationships:"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(node_lines, head, edge_lines), "\n")


def gold_records(log: DataFrame, facts: DataFrame, catalog: Catalog, key: str = "question_id",
                 sql: str = "SQL", graphs: DataFrame | None = None) -> DataFrame:
    """One record per question: the question, its graph and the context text.

    graphs: the `gold_graphs` of the log, written, where they are there already.
    """
    several = graphs is None or not graphs.filter("several").isEmpty()
    if graphs is None:
        graphs = gold_graphs(log, facts, catalog, key, sql)
    column = lambda c: F.col(c) if c in log.columns else F.lit(None).cast("string")
    questions = log.select(
        key, "db_id", first_filled(column("question_en"), column("question")).alias("question_en"),
        filled(column("question_ar")).alias("question_ar"), filled(F.col(sql)).alias(sql))
    whole = with_columns(questions, graphs, catalog, key, joins.hot_keys(log, ["db_id"]), several)
    none = lambda c: F.coalesce(F.col(c), F.array().cast(whole.schema[c].dataType)).alias(c)
    return (whole.select(*questions.columns, none("nodes"), none("edges"))
            .select(*questions.columns, F.struct("nodes", "edges").alias("gold_graph"),
                    context_text(F.col("nodes"), F.col("edges")).alias("context_text")))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) both ways from edges (src, dst)."""
    return edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")).select("e.*")


#: Neighbours in one row of an adjacency list.
CHUNK = 1024

#: Lists that a round may look up by broadcast; more are dealt out with the lists.
FEW_LISTS = 50_000


def adjacency(edges: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(vertex, chunks) and (vertex, chunk, neighbours), written: the neighbours of a hub are cut into many rows.

    Tasks are as many as the rows need. The edges are counted first, so give them written.
    """
    spark = edges.sparkSession
    keep = lambda df: sinks.staged(df, sinks.shared_folder(spark))
    ways = keep(joins.dealt(undirected(edges), ["a", "b"], 2 * edges.count()).distinct())
    ways, total = ways.withColumnRenamed("a", "vertex"), ways.count()
    degrees = keep(ways.groupBy("vertex").agg(F.count("*").alias("n")))
    chunks = keep(degrees.select("vertex", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    hubs = degrees.where(F.col("n") >= max(joins.HOT_ROWS, total * joins.HOT_SHARE)).dropna().select("vertex")  # 1 / HOT_SHARE at most
    some = not hubs.isEmpty()
    by_vertex = lambda df: joins.dealt(df, ["vertex"], total)
    if some:
        few = F.broadcast(hubs)
        mine = ways.join(F.broadcast(chunks.join(few, "vertex", "left_semi")), "vertex")
        rest = by_vertex(ways.join(few, "vertex", "left_anti")).join(by_vertex(chunks), "vertex")
        placed = mine.unionByName(rest)
    else:
        placed = by_vertex(ways).join(by_vertex(chunks), "vertex")
    placed = placed.select("vertex", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b")
    lists = ((joins.dealt(placed, ["vertex", "chunk"], total) if some else placed).groupBy("vertex", "chunk")
             .agg(F.collect_list("b").alias("neighbours")))
    return chunks, keep(lists)


def neighbourhoods(vertices: DataFrame, edges: DataFrame, origins: DataFrame, degrees: int = 2, chunk: int = CHUNK) -> DataFrame:
    """(origin, vertex, level): what each of `origins` (vertex) reaches in at most `degrees` steps, at its nearest level.

    Only origins that `vertices` (vertex) has are there, with or without an edge; vertices that edges name are reached in any
    case. Each round expands what was new in the round before and is written; it ends early if nothing is new. A frontier
    meets a hub's neighbours list by list, so no task gets all of them; the lists are shuffled only for a large one.
    """
    spark = edges.sparkSession
    keep = lambda df: sinks.staged(df, sinks.shared_folder(spark))
    start = vertices.select("vertex").join(origins.select("vertex").distinct(), "vertex", "left_semi").distinct()
    frontier = keep(start.select(F.col("vertex").alias("origin"), "vertex", F.lit(0).alias("level")))
    seen = frontier
    if degrees < 1:
        return seen
    edges = keep(edges.select("src", "dst"))
    chunks, lists = adjacency(edges, chunk)
    ways, all_lists = 2 * edges.count(), lists.count()
    for level in range(1, degrees + 1):
        new = frontier.count()
        if not new:
            break
        asked = keep((F.broadcast(frontier) if new <= FEW_LISTS else frontier).join(chunks, "vertex")
                     .select("origin", "vertex", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")))
        wanted = asked.count()
        if wanted <= FEW_LISTS:
            met = lists.join(F.broadcast(asked), ["vertex", "chunk"]).select("origin", F.explode("neighbours").alias("vertex"))
        else:
            total = max(ways, ways * wanted // all_lists)  # of neighbours, over all origins
            by_list = lambda df: joins.dealt(df, ["vertex", "chunk"], total)
            met = by_list(asked).join(by_list(lists), ["vertex", "chunk"]).select("origin", F.explode("neighbours").alias("vertex"))
            met = joins.dealt(met, ["origin", "vertex"], total)
        reached = met.distinct().join(seen, ["origin", "vertex"], "left_anti")
        frontier = keep(reached.select("origin", "vertex", F.lit(level).alias("level")))
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(vertices: DataFrame, edges: DataFrame, vertex, degrees: int = 2) -> DataFrame:
    """(vertex, level): `neighbourhoods` of one vertex; itself has level 0."""
    origin = vertices.filter(F.col("vertex") == F.lit(vertex)).select("vertex")
    return neighbourhoods(vertices, edges, origin, degrees).select("vertex", "level")


def _property_in(prop: str, values: list[str]):
    """The property counts only if it is set: null, empty text and zero do not."""
    text = F.col(prop).cast("string")
    return (text != "") & (text != "0") & text.isin([str(v) for v in values])


def vertices_with(vertices: DataFrame, prop: str, values: list[str], vertex: str = "vertex") -> DataFrame:
    """(vertex): vertices whose property is one of the values."""
    return vertices.filter(_property_in(prop, values)).select(F.col(vertex).alias("vertex"))


def ends_of_edges_with(edges: DataFrame, prop: str, values: list[str]) -> DataFrame:
    """(vertex): both ends of the edges whose property is one of the values."""
    return (edges.filter(_property_in(prop, values))
            .select(F.explode(F.array("src", "dst")).alias("vertex")).distinct())


def visible_vertices(vertices: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected ones of `vertices`, also those without an edge."""
    return vertices.join(selected.select("vertex").distinct(), "vertex", "left_semi")


def visible_subgraph(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """The edges between selected vertices."""
    chosen = selected.select("vertex").distinct()
    return (edges.join(chosen.withColumnRenamed("vertex", "src"), "src", "left_semi")
            .join(chosen.withColumnRenamed("vertex", "dst"), "dst", "left_semi")
            .select(*edges.columns))
