
from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import expected as X  # noqa: E402
from checks import workload as W  # noqa: E402
from schemaloom.functions import text as T  # noqa: E402
from schemaloom.operators import browse, catalog, enrich, extremes, graph, joins, records, refs  # noqa: E402
from schemaloom.sources import descriptions, encodings, json_docs, json_split, record_store, sinks  # noqa: E402

try:  # the training-text operators are a part of their own and may be missing
    from schemaloom.llm import expected_sql as LLM_SQL
    from schemaloom.llm import queries as LLM
    import corpus_pipeline as _  # noqa: F401
except ImportError:
    LLM = LLM_SQL = None

t = W.table


def _catalog(spark: SparkSession, d: str) -> catalog.Catalog:
    """Worked out and stored once for all queries of an application over the same tables."""
    return sinks.stored_once(spark, "catalog", d, write=lambda _: enrich.enriched_catalog(W.entries(spark, d), W.description_rows(spark, d)))


def _lookups(spark: SparkSession, d: str) -> catalog.Catalog:
    """The catalog with what graphs look up in it, stored once for the queries that do."""
    return sinks.stored_once(spark, "lookups", d, write=lambda folder: graph.stored(_catalog(spark, d), folder))


def _described(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).described


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return refs.read_log(W.query_log(spark, d).select("question_id", "SQL"))


# --- text rules -------------------------------------------------------------------------------------------------

def norm_key(spark, d):
    docs = t(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    parts = t(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"),
                                       F.concat_ws("_", "p_name", "p_brand", "p_type").alias("text"))
    return docs.unionByName(parts).select("kind", "id", T.norm_key(F.col("text")).alias("name_key"))


def norm_alnum(spark, d):
    return t(spark, d, "documents").select("doc_id", T.norm_alnum(F.col("text")).alias("letters"))


def tidy_text(spark, d):
    return t(spark, d, "documents").select("doc_id", T.tidy_text(F.col("text")).alias("tidy"))


def first_filled(spark, d):
    q = W.raw_questions(spark, d)
    return q.select("question_id", T.first_filled(F.col("question_ar"), F.col("question_en"), F.col("question"))
                    .alias("question"))


# --- sources and sinks --------------------------------------------------------------------------------------------

def decode_files(spark, d):
    """Each document's text as the bytes of a file: UTF-8 with a mark, UTF-8, or one byte per character."""
    text, kind = F.col("text"), F.col("doc_id") % 3
    # Characters that Latin-1 lacks leave a document in UTF-8.
    narrow = F.regexp_like(text, F.lit(r"^[\x00-\x7f\xa0-\xff]*$"))
    content = (F.when((kind == 0) & narrow, F.encode(text, "ISO-8859-1"))
               .when(kind == 1, F.encode(F.concat(F.lit("\ufeff"), text), "UTF-8")).otherwise(F.encode(text, "UTF-8")))
    return (t(spark, d, "documents").select("doc_id", content.alias("content"))
            .select("doc_id", encodings.decode_best(F.col("content")).alias("text")))


def json_array_items(spark, d):
    """The lines of each document as a JSON array of objects, read back as rows."""
    lines = F.to_json(F.transform(F.split("text", "\n", -1), lambda s, i: F.struct(
        i.alias("line_no"), s.alias("line"))))
    docs = t(spark, d, "documents").select("doc_id", lines.alias("text"))
    return json_docs.explode_items(docs, "line_no int, line string")


def json_array_split(spark, d):
    """Documents as objects among other items of one array a source, read back by ranges; strings hold brackets and quotes."""
    odd = F.concat(F.lit('}, {"doc_id": 0} ['), F.col("text"), F.lit('] "\\'))
    item = F.to_json(F.struct("doc_id", odd.alias("text"), F.array(F.struct(F.lit("}").alias("deep"))).alias("more")))
    docs = t(spark, d, "documents").select("source", "doc_id", F.concat(F.lit(', "}", '), item).alias("value"))
    ends = docs.select("source").distinct().select("source", F.explode(F.map_from_arrays(
        F.array(F.lit(-1), F.lit(2**62)).cast("array<long>"), F.array(F.lit("[0"), F.lit("]")))).alias("doc_id", "value"))
    folder = sinks.shared_folder(spark)
    (docs.unionByName(ends).repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id")
     .write.partitionBy("source").text(folder, lineSep="\n"))
    read = json_split.read_array_split(spark, folder, "doc_id long, text string")
    return read.select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), "pos", "doc_id", "text")


def description_csv(spark, d):
    """The lines of each document as a CSV file with header and quoted cells, read back as description rows."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    cells = F.transform(F.split("text", "\n\n|\n", -1), lambda s, i: F.concat_ws(
        ",", F.concat(F.lit("col "), i.cast("string")), quoted(F.concat(s, F.lit("\nnext line")))))
    body = F.concat(F.lit("original_column_name,column_description\r\n"), F.array_join(cells, "\r\n"))
    files = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), body.alias("text"))
    return descriptions.parse_files(files).select("path", "row_no", "original_column_name", "column_description")


def resolve_folders(spark, d):
    """Sources as database ids; folders spell them in two ways, under three roots."""
    docs = t(spark, d, "documents")
    ids = docs.select(F.col("source").alias("db_id"))
    folders = docs.select(
        (F.col("doc_id") % 3).cast("int").alias("root_ord"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source"))
        .otherwise(F.concat(F.upper("source"), F.lit("-"), F.lit("_"))).alias("folder"))
    return descriptions.resolve_folders(ids, folders)


def chunk_files(spark, d):
    """Records split, written as chunk files to the shared folder, and read back."""
    numbered = records.dense_ordinal(
        records.bilingual(W.raw_questions(spark, d)).select("question_id", "question_en", "evidence_en"), "question_id")
    folder = sinks.shared_folder(spark)
    sinks.write_chunks(records.split_contiguous(numbered, 4).drop("idx"), folder, "questions", 4)
    return sinks.read_chunks(spark, folder, "question_id long, question_en string, evidence_en string")


# --- flat schemas -------------------------------------------------------------------------------------------------

def latest_entries(spark, d):
    """One entry per source: that of its last document."""
    tagged = t(spark, d, "documents").select("source", "doc_id", "lang").withColumnRenamed("source", "db_id")
    return catalog.latest_entries(tagged, "doc_id").select("db_id", "doc_id", "lang")


def table_columns(spark, d):
    lists = catalog.table_columns(_described(spark, d))
    text = F.array_join(F.transform("columns", lambda c: T.labelled(c["name"], c["description"])), "; ")
    return lists.select("db_id", "table_name", text.alias("columns"))


# --- descriptions ---------------------------------------------------------------------------------------------------

def column_descriptions(spark, d):
    return _described(spark, d).select("db_id", "col_idx", "table_original", "original", "description")


def fk_descriptions(spark, d):
    c = _catalog(spark, d)
    return enrich.fk_descriptions(catalog.foreign_keys(W.entries(spark, d)), c.described)


def _report(spark, d, by_db):
    c = _catalog(spark, d)
    entries = W.entries(spark, d)
    fks = enrich.fk_descriptions(catalog.foreign_keys(entries), c.described)
    return enrich.enrichment_report(entries, fks, c.described, by_db)


def nested_entries(spark, d):
    """Per database: how many descriptions the written entry carries, and their text in order."""
    c = _catalog(spark, d)
    entries = W.entries(spark, d)
    fks = enrich.fk_descriptions(catalog.foreign_keys(entries), c.described)
    return enrich.nested_entries(entries, fks, c.described).select(
        "db_id", F.size("column_descriptions").alias("n_columns"),
        F.array_join("column_descriptions", "|").alias("column_descriptions"),
        F.array_join(F.transform("foreign_key_descriptions", lambda k: k["summary"]), "|").alias("summaries"))


# --- what the query log says ----------------------------------------------------------------------------------------

def using_natural(spark, d):
    return refs.using_natural(_parsed(spark, d)).withColumn("columns", F.array_join("columns", ","))


# --- graphs -----------------------------------------------------------------------------------------------------------

def _log_and_facts(spark, d, c):
    """The log of known databases, and what was read out of its text, each written once for the queries that share it."""
    def write(folder: str) -> tuple[DataFrame, DataFrame]:
        log = sinks.staged(graph.in_catalog(W.query_log(spark, d), c), f"{folder}/log")
        return log, sinks.staged(refs.query_facts(joins.spread(log, joins.TEXTS)), f"{folder}/facts")
    return sinks.stored_once(spark, "facts", d, write=write)


def gold_edges(spark, d):
    c = _lookups(spark, d)
    return graph.gold_edges(_log_and_facts(spark, d, c)[1], c)


def resolve_tables(spark, d):
    c = _lookups(spark, d)
    return graph.gold_nodes(*_log_and_facts(spark, d, c), c)


def gold_nodes(spark, d):
    c = _lookups(spark, d)
    return graph.node_columns(graph.gold_nodes(*_log_and_facts(spark, d, c), c), c)


def _records(spark, d):
    """Records over the graphs, which are written once. Columns and texts, many times as large, go straight into what is asked for."""
    c = _lookups(spark, d)
    log, facts = _log_and_facts(spark, d, c)
    graphs = sinks.stored_once(spark, "graphs", d, write=lambda folder: sinks.staged(graph.gold_graphs(log, facts, c), folder))
    return graph.gold_records(log, facts, c, graphs=graphs)


def gold_context(spark, d):
    return _records(spark, d).select("question_id", "context_text")


def gold_records(spark, d):
    names = F.array_join(F.transform("gold_graph.nodes", lambda n: n["table_name"]), ",")
    return _records(spark, d).select(
        "question_id", "db_id", "question_en", "question_ar", names.alias("node_names"),
        F.size("gold_graph.edges").alias("n_edges"), "context_text")


def customer_edges(spark, d):
    """Customers and the suppliers they buy from, each pair once."""
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    items = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    total = items.count()
    met = (joins.dealt(items, ["l_orderkey"], total)
           .join(joins.dealt(orders, ["o_orderkey"], total), F.col("l_orderkey") == F.col("o_orderkey"))
           .select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
                   F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), "l_returnflag"))
    return joins.dealt(met, ["src", "dst"], total).distinct()


def neighbourhood(spark, d):
    return graph.neighbourhood(_customers(spark, d), customer_edges(spark, d).select("src", "dst"), "c7")


def neighbourhoods(spark, d):
    """What three customers reach in three steps: suppliers, their customers, and the suppliers of those."""
    origins = spark.createDataFrame([("c7",), ("c11",), ("c23",)], "vertex string")
    return graph.neighbourhoods(_customers(spark, d), customer_edges(spark, d).select("src", "dst"), origins, 3)


def _customers(spark, d):
    return t(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("vertex"), "c_mktsegment", "c_nationkey")


def graph_filter(spark, d):
    return graph.vertices_with(_customers(spark, d), "c_mktsegment", ["MACHINERY", "FURNITURE"])


def graph_filter_edges(spark, d):
    return graph.ends_of_edges_with(customer_edges(spark, d), "l_returnflag", ["R"])


def visible_vertices(spark, d):
    """Customers of two segments, with or without an order."""
    return graph.visible_vertices(_customers(spark, d), graph_filter(spark, d)).select("vertex")


def visible_subgraph(spark, d):
    suppliers = t(spark, d, "supplier").filter("s_acctbal > 0").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("vertex"))
    return graph.visible_subgraph(customer_edges(spark, d), graph_filter(spark, d).unionByName(suppliers))


# --- records ----------------------------------------------------------------------------------------------------------

def bilingual_records(spark, d):
    return records.bilingual(W.raw_questions(spark, d))


def _split_questions(spark, d):
    """English documents as the file `train`, the others as `dev`, one after the other."""
    q = W.raw_questions(spark, d).drop("toxic").join(t(spark, d, "documents").select(
        F.col("doc_id").alias("question_id"), "lang"), "question_id")
    return records.union_files(q.filter("lang = 'en'").drop("lang"), q.filter("lang <> 'en'").drop("lang"))


def union_files(spark, d):
    return _split_questions(spark, d).select("question_id", "db_id", "file_ord")


def _store(spark, d):
    """The finished records as a stored table, written once for the queries that look something up."""
    return sinks.stored_once(spark, "store", d, write=lambda folder: record_store.write_store(_finished(spark, d), folder, "question_id"))


def _finished(spark, d):
    q = _split_questions(spark, d)
    split = F.when(F.col("file_ord") == 0, "train").otherwise("dev").alias("split")
    return records.bilingual(q).withColumnRenamed("question_ar", "_").select(
        "question_id", "db_id", "question_en", F.lit("").alias("question_ar"), split,
        F.concat(F.lit("SELECT * FROM "), F.col("db_id")).alias("SQL"))


def split_contiguous(spark, d):
    q = records.dense_ordinal(t(spark, d, "documents").select("doc_id"), "doc_id")
    return records.split_contiguous(q, 7)


def file_ordinal(spark, d):
    """Conversation turns as the positions in one file per role."""
    c = t(spark, d, "conversations").groupBy("role", "conv_id").agg(F.count("*").alias("turns"))
    roles = c.select("role", F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1)
                     .otherwise(2).alias("file_ord"), "conv_id")
    placed = records.dense_ordinal(roles, "conv_id", ["file_ord", "role"]).withColumnRenamed("idx", "pos")
    return records.file_ordinal(placed).select("role", "conv_id", "idx")


def merge_translations(spark, d):
    c = t(spark, d, "conversations")
    chunk = lambda role, field: c.filter(F.col("role") == role).select(
        F.col("conv_id").alias("question_id"), "turn",
        *[(F.col("text") if f == field else F.lit("")).alias(f) for f in ("question_ar", "evidence_ar")])
    base = records.bilingual(W.raw_questions(spark, d)).select(
        "question_id", "question_en", "question_ar", "evidence_ar")
    return records.merge_translations(base, [chunk("system", "question_ar"), chunk("user", "question_ar"),
                                             chunk("assistant", "evidence_ar")], order=["turn"])


# --- extremes -----------------------------------------------------------------------------------------------------------

def tied_extreme(spark, d):
    return extremes.tied_extreme(t(spark, d, "part"), F.abs("p_size")).select("p_partkey", "p_size")


def tied_extreme_filtered(spark, d):
    p = t(spark, d, "part").filter("p_size is not null and p_size between 10 and 40")
    return extremes.tied_extreme(p, F.col("p_size"), "min").select("p_partkey", "p_name", "p_size")


def tied_extreme_join(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return extremes.tied_extreme(joined, F.col("o_orderpriority"), "min", scope=o).select(
        "o_orderkey", "c_name", "o_orderpriority")


def tied_extreme_scope(spark, d):
    """Extreme over a joined and filtered set, looked up in a wider join."""
    s, n, r = t(spark, d, "supplier"), t(spark, d, "nation"), t(spark, d, "region")
    inner = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    scope = inner.filter("r_name = 'ASIA'")
    items = t(spark, d, "lineitem").join(inner, F.col("l_suppkey") == F.col("s_suppkey")).filter("r_name = 'ASIA'")
    return extremes.tied_extreme(items, F.col("s_acctbal"), "max", scope).select(
        "l_orderkey", "l_linenumber", "l_partkey", "s_name", "n_name", "s_acctbal")


def tied_extreme_by_key(spark, d):
    """In every region the lines of the suppliers with the region's largest balance."""
    s, n, r = t(spark, d, "supplier"), t(spark, d, "nation"), t(spark, d, "region")
    scope = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    items = t(spark, d, "lineitem").join(scope, F.col("l_suppkey") == F.col("s_suppkey"))
    return extremes.tied_extreme_by_key(items, ["r_name"], F.col("s_acctbal"), "max", scope).select(
        "r_name", "l_orderkey", "l_linenumber", "l_partkey", "s_name", "s_acctbal")


def nested_extreme(spark, d):
    """Among the rows at the earliest date, those at the smallest price class of that date."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey).filter("c_mktsegment = 'MACHINERY'")
    day = F.col("o_orderdate").cast("date").cast("string")
    return extremes.tied_extreme(joined, F.struct(day, F.col("o_orderpriority")), "min").select(
        "o_orderkey", "c_custkey", "o_orderpriority")


def extreme_ratio(spark, d):
    l = t(spark, d, "lineitem").filter("l_tax is not null and l_discount is not null and l_discount <> 0")
    rated = l.withColumn("ratio", extremes.guarded_ratio(F.col("l_tax"), F.col("l_discount")))
    return extremes.tied_extreme(rated, F.col("ratio")).select("l_orderkey", "l_linenumber", "l_partkey", "ratio")


def extreme_groups_max(spark, d):
    l = t(spark, d, "lineitem").filter("l_quantity - l_linenumber > 0")
    top = extremes.extreme_groups(l, ["l_suppkey"], "max")
    return top.join(t(spark, d, "supplier"), top.l_suppkey == F.col("s_suppkey")).select(
        "l_suppkey", "s_name", "group_count")


def extreme_groups_min(spark, d):
    o = t(spark, d, "orders").filter("o_totalprice - 100000 < 0")
    return extremes.extreme_groups(o, ["o_custkey"], "min")


def extreme_group_member(spark, d):
    """A stable pick of a column outside the grouping, for the group of largest count."""
    e = t(spark, d, "events")
    top = extremes.extreme_groups(e, ["event_type"], "max", F.col("value"))
    return e.join(top, "event_type").groupBy("event_type", "group_count").agg(F.min("user_id").alias("user_id"))


def earliest_in_year(spark, d):
    o = t(spark, d, "orders").filter(extremes.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")) == "1997")
    return extremes.first_by(o, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "o_custkey")


def years_between(spark, d):
    """Groups by text year within a range, taken with substr and with the date function."""
    o = t(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    year = extremes.year_of(F.col("day"))
    return (o.filter(year.between("1996", "1998") & (F.substring("day", 1, 4) != "1997"))
            .groupBy(year.alias("year"), "o_orderstatus").agg(F.count("*").alias("orders")))


def count_at_extreme(spark, d):
    p = t(spark, d, "part").filter("p_size is not null and p_type <> 'SMALL'")
    return extremes.tied_extreme(p, F.col("p_size")).agg(F.count("p_partkey").alias("parts"))


def distinct_at_extreme(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return extremes.tied_extreme(joined, F.col("o_orderstatus"), "max", scope=o).select("c_name").distinct()


def truthy_filter(spark, d):
    l = t(spark, d, "lineitem")
    return extremes.tied_extreme(l, F.col("l_quantity"), "min").filter(
        extremes.truthy(F.col("l_discount") * 100)).select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


def text_number_match(spark, d):
    brand = F.regexp_replace("p_brand", "Brand#", "")
    return (t(spark, d, "part").filter(extremes.text_equals_number(brand, 11))
            .groupBy("p_type").agg(F.count("*").alias("parts")))


def entry(spark: SparkSession) -> DataFrame:
    """The equality joins of every logged query, with the foreign key each one follows."""
    return gold_edges(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _own_queries() | (LLM.queries() if LLM else {})


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "norm_key": norm_key,
        "norm_alnum": norm_alnum,
        "tidy_text": tidy_text,
        "first_filled": first_filled,
        "decode_files": decode_files,
        "json_array_items": json_array_items,
        "json_array_split": json_array_split,
        "description_csv": description_csv,
        "resolve_db_root": resolve_folders,
        "chunk_files": chunk_files,
        "latest_entries": latest_entries,
        "schema_tables": lambda s, d: catalog.tables(W.entries(s, d)),
        "schema_columns": lambda s, d: catalog.columns(W.entries(s, d)),
        "schema_fks": lambda s, d: catalog.foreign_keys(W.entries(s, d)),
        "dropped_fks": lambda s, d: catalog.dropped_foreign_keys(W.entries(s, d)),
        "table_columns": table_columns,
        "unique_owners": lambda s, d: catalog.unique_owners(catalog.columns(W.entries(s, d))),
        "column_desc_lookup": lambda s, d: enrich.description_map(W.description_rows(s, d)),
        "column_descriptions": column_descriptions,
        "fk_descriptions": fk_descriptions,
        "enrichment_report": lambda s, d: _report(s, d, False),
        "enrichment_report_by_db": lambda s, d: _report(s, d, True),
        "nested_entries": nested_entries,
        "table_refs": lambda s, d: refs.table_refs(_parsed(s, d)),
        "readable_texts": lambda s, d: _parsed(s, d).select("question_id", "parse_ok"),
        "alias_map": lambda s, d: refs.alias_map(_parsed(s, d)),
        "equi_pairs": lambda s, d: refs.equi_pairs(_parsed(s, d)),
        "using_natural": using_natural,
        "column_refs": lambda s, d: refs.column_refs(_parsed(s, d)),
        "resolve_tables": resolve_tables,
        "gold_nodes": gold_nodes,
        "gold_edges": gold_edges,
        "gold_context": gold_context,
        "gold_records": gold_records,
        "view_nodes": lambda s, d: browse.view_nodes(_records(s, d)),
        "view_links": lambda s, d: browse.view_links(_records(s, d)),
        "item_lines": lambda s, d: browse.item_lines(_records(s, d)),
        "neighbourhood": neighbourhood,
        "neighbourhoods": neighbourhoods,
        "graph_filter": graph_filter,
        "graph_filter_edges": graph_filter_edges,
        "visible_subgraph": visible_subgraph,
        "visible_vertices": visible_vertices,
        "bilingual_records": bilingual_records,
        "change_report": lambda s, d: records.change_report(W.raw_questions(s, d)),
        "union_files": union_files,
        "split_contiguous": split_contiguous,
        "dense_ordinal": lambda s, d: records.dense_ordinal(t(s, d, "orders").select(
            "o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"]),
        "file_ordinal": file_ordinal,
        "merge_translations": merge_translations,
        "db_counts": lambda s, d: _store(s, d).db_counts(),
        "list_records": lambda s, d: _store(s, d).list_records("DEV", "src3"),
        "record_at": lambda s, d: _store(s, d).record_at(11),
        "search_records": lambda s, d: _store(s, d).search(" FROM src1", "dev"),
        "search_all": lambda s, d: _store(s, d).search("or the", "train"),
        "search_short": lambda s, d: _store(s, d).search("Or", "train", "src3"),
        "tied_extreme": tied_extreme,
        "tied_extreme_filtered": tied_extreme_filtered,
        "tied_extreme_join": tied_extreme_join,
        "tied_extreme_scope": tied_extreme_scope,
        "tied_extreme_by_key": tied_extreme_by_key,
        "nested_extreme": nested_extreme,
        "extreme_ratio": extreme_ratio,
        "extreme_groups_max": extreme_groups_max,
        "extreme_groups_min": extreme_groups_min,
        "extreme_group_member": extreme_group_member,
        "earliest_in_year": earliest_in_year,
        "years_between": years_between,
        "count_at_extreme": count_at_extreme,
        "distinct_at_extreme": distinct_at_extreme,
        "truthy_filter": truthy_filter,
        "text_number_match": text_number_match,
    }


_CUSTOMER_EDGES = ("edges AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, l_returnflag "
                   "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
_RAW = """raw AS (SELECT doc_id AS question_id, source AS db_id, lang, text, doc_id % 3 AS kind,
    CASE quality WHEN 1 THEN 'simple' WHEN 0 THEN 'moderate' END AS difficulty, toxic
    FROM documents LEFT JOIN labels USING (doc_id))"""
_BROWSED = """browsed AS (SELECT question_id, db_id, text AS question_en, '' AS question_ar,
    CASE WHEN lang = 'en' THEN 'train' ELSE 'dev' END AS split, 'SELECT * FROM ' || db_id AS SQL,
    row_number() OVER (PARTITION BY lang = 'en' ORDER BY question_id) - 1 AS idx FROM raw)"""
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def oracle_sql() -> dict[str, str]:
    return _own_sql() | (LLM_SQL.oracle_sql() if LLM else {})


def _own_sql() -> dict[str, str]:
    log = X.sql
    return {
        "norm_key": f"""SELECT 'document' AS kind, doc_id AS id, {X.NORM('text')} AS name_key FROM documents UNION ALL
            SELECT 'part', p_partkey, {X.NORM("p_name || '_' || p_brand || '_' || p_type")} FROM part""",
        "norm_alnum": "SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS letters FROM documents",
        "tidy_text": "SELECT doc_id, CASE WHEN text = '' THEN '' ELSE rtrim(trim(regexp_replace(text, '\\s+', ' ', "
                     "'g')), '.') || '.' END AS tidy FROM documents",
        "first_filled": "SELECT doc_id AS question_id, text AS question FROM documents",
        "decode_files": "SELECT doc_id, text FROM documents",
        "json_array_items": """SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CAST(i - 1 AS INTEGER) AS line_no, line
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
        "json_array_split": """SELECT source, CAST(2 * row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS pos,
            doc_id, '}, {"doc_id": 0} [' || text || '] "\\' AS text FROM documents""",
        "description_csv": """SELECT CAST(doc_id AS VARCHAR) AS path, CAST(i - 1 AS INTEGER) AS row_no,
            'col ' || (i - 1) AS original_column_name, line || chr(10) || 'next line' AS column_description
            FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\n|\\n')) AS line,
                  generate_subscripts(regexp_split_to_array(text, '\\n\\n|\\n'), 1) AS i FROM documents)""",
        "resolve_db_root": f"""WITH folders AS (SELECT DISTINCT doc_id % 3 AS root_ord, CASE WHEN doc_id % 2 = 0 THEN
            source ELSE upper(source) || '-_' END AS folder FROM documents),
            ranked AS (SELECT source AS db_id, CAST(root_ord AS INTEGER) AS root_ord, folder, row_number() OVER (
              PARTITION BY source ORDER BY root_ord, folder <> source, folder) AS rn
              FROM (SELECT DISTINCT source FROM documents) JOIN folders ON {X.NORM('source')} = {X.NORM('folder')})
            SELECT db_id, root_ord, folder FROM ranked WHERE rn = 1""",
        "chunk_files": """SELECT doc_id AS question_id, text AS question_en, CASE WHEN doc_id % 3 = 1 THEN '' ELSE lang
            END AS evidence_en, 'questions_part' || ntile(4) OVER (ORDER BY doc_id) || 'of4' AS chunk FROM documents""",
        "latest_entries": "SELECT source AS db_id, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents "
                          "GROUP BY source",
        "schema_tables": log(X.SCHEMA, select="SELECT db_id, t_idx, original, canonical FROM docs JOIN vt USING (lang)"),
        "schema_columns": log(X.SCHEMA, select="SELECT db_id, vc.* EXCLUDE (lang) FROM docs JOIN vc USING (lang)"),
        "schema_fks": log(X.SCHEMA, select="SELECT db_id, vf.* EXCLUDE (lang) FROM docs JOIN vf USING (lang)"),
        "dropped_fks": log(X.DOCS, select="SELECT db_id, CAST(2 AS BIGINT) AS dropped FROM docs"),
        "table_columns": log(X.SCHEMA, X.DESCRIBED, select="""SELECT db_id, table_canonical AS table_name, string_agg(
            CASE WHEN description = '' THEN canonical ELSE canonical || ': ' || description END, '; ' ORDER BY col_idx)
            AS columns FROM described WHERE t_idx >= 0 GROUP BY ALL"""),
        "unique_owners": log(X.SCHEMA, select="""SELECT db_id, canonical AS name, min(table_canonical) AS owner
            FROM docs JOIN vc USING (lang) WHERE t_idx >= 0 GROUP BY ALL HAVING count(DISTINCT table_canonical) = 1"""),
        "column_desc_lookup": log(X.SCHEMA, X.DESCRIPTIONS, select="SELECT * FROM dmap"),
        "column_descriptions": log(X.SCHEMA, X.DESCRIBED, select="SELECT db_id, col_idx, table_original, original, "
                                   "description FROM described"),
        "fk_descriptions": log(X.SCHEMA, X.FK, select="SELECT * FROM fks"),
        "enrichment_report": log(X.SCHEMA, X.FK, select="""SELECT CAST((SELECT count(*) FROM docs) AS BIGINT) AS
            databases, (SELECT count(*) FROM fks WHERE child_description = '' AND parent_description = '') AS
            missing_fk_descriptions, (SELECT count(*) FROM described WHERE t_idx >= 0 AND description = '') AS
            missing_column_descriptions, 2 * (SELECT count(*) FROM docs) AS dropped_fks"""),
        "enrichment_report_by_db": log(X.SCHEMA, X.FK, select="""SELECT db_id, CAST(1 AS BIGINT) AS databases,
            (SELECT count(*) FROM fks f WHERE f.db_id = docs.db_id AND child_description = '' AND
             parent_description = '') AS missing_fk_descriptions,
            (SELECT count(*) FROM described c WHERE c.db_id = docs.db_id AND t_idx >= 0 AND description = '') AS
            missing_column_descriptions, CAST(2 AS BIGINT) AS dropped_fks FROM docs"""),
        "nested_entries": log(X.SCHEMA, X.FK, select="""SELECT db_id, CAST(n AS INTEGER) AS n_columns,
            column_descriptions, summaries
            FROM (SELECT db_id, count(*) AS n, string_agg(description, '|' ORDER BY col_idx) AS column_descriptions
                  FROM described GROUP BY ALL)
            JOIN (SELECT db_id, string_agg(summary, '|' ORDER BY fk_pos) AS summaries FROM fks GROUP BY ALL)
            USING (db_id)"""),
        "table_refs": log(X.LOG, X.by_shape("r", "name, alias", X.TABLES),
                          select="SELECT question_id, pos, name, alias FROM log JOIN r USING (k)"),
        "readable_texts": log(X.LOG, select=f"SELECT question_id, k NOT IN {W.BROKEN} AS parse_ok FROM log"),
        "alias_map": log(X.LOG, X.by_shape("m", "qualifier, table_name", {
            k: list(X.ALIASES[k].items()) for k in X.TABLES}),
            select="SELECT question_id, qualifier, table_name FROM log JOIN m USING (k)"),
        "equi_pairs": log(X.LOG, X.by_shape("p", "left_qualifier, left_column, right_qualifier, right_column", X.PAIRS),
                          select="SELECT question_id, p.* EXCLUDE (k) FROM log JOIN p USING (k)"),
        "using_natural": log(X.LOG, X.by_shape("u", "left_table, right_table, columns", {
            k: [(a, b, ",".join(c)) for a, b, c in v] for k, v in X.BY_NAME.items()}),
            select="SELECT question_id, u.* EXCLUDE (k) FROM log JOIN u USING (k)"),
        "column_refs": log(X.LOG, X.by_shape("q", "qualifier, name", {
            k: sorted({*X.QUALIFIED.get(k, []), *[p[:2] for p in X.PAIRS.get(k, [])],
                       *[p[2:] for p in X.PAIRS.get(k, [])]}) for k in X.TABLES}),
            select="SELECT question_id, qualifier, name FROM log JOIN q USING (k)"),
        "resolve_tables": log(X.DOCS, X.KNOWN, X.NODES, select="SELECT * FROM nodes"),
        "gold_nodes": log(X.SCHEMA, X.DESCRIBED, X.KNOWN, X.NODE_COLUMNS, select="SELECT * FROM node_columns"),
        "gold_edges": log(X.SCHEMA, X.FK, X.KNOWN, X.EDGES, select="SELECT * FROM edges"),
        "gold_context": log(X.SCHEMA, X.FK, X.KNOWN, X.CONTEXT, select="SELECT question_id, context_text FROM context"),
        "gold_records": log(X.SCHEMA, X.FK, X.KNOWN, X.CONTEXT, select="""SELECT c.question_id, c.db_id, question_en,
            '' AS question_ar, coalesce(n.names, '') AS node_names, CAST(coalesce(e.n, 0) AS INTEGER) AS n_edges,
            context_text FROM context c
            LEFT JOIN (SELECT question_id, string_agg(table_name, ',' ORDER BY table_name) AS names FROM nodes
                       GROUP BY ALL) n USING (question_id)
            LEFT JOIN (SELECT question_id, count(*) AS n FROM edges GROUP BY ALL) e USING (question_id)"""),
        "view_nodes": log(X.SCHEMA, X.DESCRIBED, X.KNOWN, X.NODE_COLUMNS, select="""SELECT question_id, table_name AS id,
            table_name AS label, string_agg(CASE WHEN description = '' THEN column_name ELSE '<b>' || column_name ||
            '</b> : ' || description END, '<br/>' ORDER BY col_pos) AS title FROM node_columns GROUP BY ALL"""),
        "view_links": log(X.SCHEMA, X.FK, X.KNOWN, X.EDGES, select="""SELECT question_id, child_table AS src,
            parent_table AS dst, child_column || ' → ' || parent_column AS label, description AS title FROM edges"""),
        "item_lines": log(X.SCHEMA, X.DESCRIBED, X.KNOWN, X.NODE_COLUMNS, select="""SELECT question_id, table_name,
            CASE WHEN description = '' THEN column_name ELSE column_name || ': ' || description END AS line
            FROM node_columns"""),
        "neighbourhood": log(_CUSTOMER_EDGES, "pairs AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src "
                             "FROM edges)", "one AS (SELECT b FROM pairs WHERE a = 'c7')", select="""SELECT vertex,
            min(level) AS level FROM (SELECT 'c7' AS vertex, 0 AS level UNION ALL SELECT b, 1 FROM one UNION ALL
            SELECT b, 2 FROM pairs WHERE a IN (SELECT b FROM one)) GROUP BY ALL"""),
        "neighbourhoods": log(_CUSTOMER_EDGES, "pairs AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)",
            "zero AS (SELECT 'c' || c_custkey AS origin, 'c' || c_custkey AS vertex FROM customer WHERE c_custkey IN (7, 11, 23))",
            "one AS (SELECT DISTINCT origin, b AS vertex FROM zero JOIN pairs ON a = vertex)",
            "two AS (SELECT DISTINCT origin, b AS vertex FROM one JOIN pairs ON a = vertex)",
            "three AS (SELECT DISTINCT origin, b AS vertex FROM two JOIN pairs ON a = vertex)",
            select="""SELECT origin, vertex, min(level) AS level FROM (SELECT *, 0 AS level FROM zero UNION ALL SELECT *, 1 FROM one
            UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three) GROUP BY ALL"""),
        "graph_filter": "SELECT 'c' || c_custkey AS vertex FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE')",
        "graph_filter_edges": log(_CUSTOMER_EDGES, select="SELECT src AS vertex FROM edges WHERE l_returnflag = 'R' "
                                  "UNION SELECT dst FROM edges WHERE l_returnflag = 'R'"),
        "visible_vertices": "SELECT 'c' || c_custkey AS vertex FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE')",
        "visible_subgraph": log(_CUSTOMER_EDGES, select="""SELECT * FROM edges WHERE src IN (SELECT 'c' || c_custkey
            FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE')) AND dst IN (SELECT 's' || s_suppkey
            FROM supplier WHERE s_acctbal > 0)"""),
        "bilingual_records": log(_RAW, select="""SELECT question_id, db_id, text AS question_en, '' AS question_ar,
            CASE WHEN kind = 1 THEN '' ELSE lang END AS evidence_en, '' AS evidence_ar, difficulty, toxic FROM raw"""),
        "change_report": log(_RAW, select="""SELECT count(*) AS records, count_if(kind <> 2)::BIGINT AS changed,
            count_if(kind = 0)::BIGINT AS legacy_question, count_if(kind = 0)::BIGINT AS legacy_evidence,
            count_if(kind = 0)::BIGINT AS missing_question_en, count_if(kind <> 2)::BIGINT AS missing_question_ar,
            count_if(kind <> 2)::BIGINT AS missing_evidence_en, count_if(kind <> 2)::BIGINT AS missing_evidence_ar
            FROM raw"""),
        "union_files": "SELECT doc_id AS question_id, source AS db_id, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS "
                       "file_ord FROM documents",
        "split_contiguous": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, CAST(ntile(7) OVER (ORDER BY "
                            "doc_id) AS INTEGER) AS part FROM documents",
        "dense_ordinal": "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY "
                         "o_orderkey) - 1 AS idx FROM orders",
        "file_ordinal": "SELECT role, conv_id, row_number() OVER (ORDER BY CASE role WHEN 'user' THEN "
                        "0 WHEN 'assistant' THEN 1 ELSE 2 END, conv_id) - 1 AS idx "
                        "FROM (SELECT DISTINCT role, conv_id FROM conversations)",
        "merge_translations": """SELECT doc_id AS question_id, text AS question_en, coalesce(u, '') AS question_ar,
            coalesce(a, '') AS evidence_ar FROM documents LEFT JOIN (SELECT conv_id,
            coalesce(last(text ORDER BY turn, text) FILTER (WHERE role = 'user' AND text <> ''),
                     last(text ORDER BY turn, text) FILTER (WHERE role = 'system' AND text <> '')) AS u,
            last(text ORDER BY turn, text) FILTER (WHERE role = 'assistant' AND text <> '') AS a FROM conversations GROUP BY ALL)
            ON conv_id = doc_id""",
        "db_counts": log(_RAW, _BROWSED, select="SELECT split, db_id, count(*) AS count FROM browsed GROUP BY ALL"),
        "list_records": log(_RAW, _BROWSED, select="SELECT idx, db_id, question_en, question_ar, SQL FROM browsed "
                            "WHERE split = 'dev' AND db_id = 'src3'"),
        "record_at": log(_RAW, _BROWSED, select="SELECT * FROM browsed WHERE split = 'train' AND idx = 11"),
        "search_records": log(_RAW, _BROWSED, select="""SELECT idx, db_id, question_en, question_ar, SQL FROM browsed
            WHERE split = 'dev' AND (contains(lower(question_en), ' from src1') OR contains(lower(SQL), ' from src1'))"""),
        "search_short": log(_RAW, _BROWSED, select="""SELECT idx, db_id, question_en, question_ar, SQL FROM browsed
            WHERE split = 'train' AND db_id = 'src3' AND contains(lower(question_en || ' ' || SQL), 'or')"""),
        "search_all": log(_RAW, _BROWSED, select="""SELECT idx, db_id, question_en, question_ar, SQL FROM browsed
            WHERE split = 'train' AND contains(lower(question_en || ' ' || SQL), 'or the')"""),
        "tied_extreme": "SELECT p_partkey, p_size FROM part WHERE abs(p_size) = (SELECT max(abs(p_size)) FROM part)",
        "tied_extreme_filtered": """SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 10 AND 40 AND
            p_size = (SELECT min(p_size) FROM part WHERE p_size BETWEEN 10 AND 40)""",
        "tied_extreme_join": """SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey =
            c_custkey WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)""",
        "tied_extreme_scope": """SELECT l_orderkey, l_linenumber, l_partkey, s_name, n_name, s_acctbal FROM lineitem
            JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey =
            r_regionkey WHERE r_name = 'ASIA' AND s_acctbal = (SELECT max(s_acctbal) FROM supplier JOIN nation ON
            s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""",
        "tied_extreme_by_key": """WITH s AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON
            n_regionkey = r_regionkey), top AS (SELECT r_name, max(s_acctbal) AS best FROM s GROUP BY ALL) SELECT r_name, l_orderkey,
            l_linenumber, l_partkey, s_name, s_acctbal FROM lineitem JOIN s ON l_suppkey = s_suppkey JOIN top USING (r_name)
            WHERE s_acctbal = best""",
        "nested_extreme": f"""WITH j AS (SELECT *, {_DAY} AS day FROM orders JOIN customer ON o_custkey = c_custkey WHERE
            c_mktsegment = 'MACHINERY') SELECT o_orderkey, c_custkey, o_orderpriority FROM j WHERE day = (SELECT
            min(day) FROM j) AND o_orderpriority = (SELECT min(o_orderpriority) FROM j WHERE day = (SELECT min(day)
            FROM j))""",
        "extreme_ratio": """SELECT l_orderkey, l_linenumber, l_partkey, l_tax / l_discount AS ratio FROM lineitem WHERE
            l_discount <> 0 AND l_tax / l_discount = (SELECT max(l_tax / l_discount) FROM lineitem WHERE
            l_discount <> 0)""",
        "extreme_groups_max": """WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity - l_linenumber
            > 0 GROUP BY ALL) SELECT l_suppkey, s_name, n AS group_count FROM c JOIN supplier ON l_suppkey = s_suppkey
            WHERE n = (SELECT max(n) FROM c)""",
        "extreme_groups_min": """SELECT o_custkey, count(*) AS group_count FROM orders WHERE o_totalprice - 100000 < 0
            GROUP BY o_custkey HAVING count(*) = (SELECT min(n) FROM (SELECT count(*) AS n FROM orders WHERE
            o_totalprice - 100000 < 0 GROUP BY o_custkey))""",
        "extreme_group_member": """SELECT event_type, count(value) AS group_count, min(user_id) AS user_id FROM events
            GROUP BY event_type HAVING count(value) = (SELECT max(n) FROM (SELECT count(value) AS n FROM events GROUP BY
            event_type))""",
        "earliest_in_year": f"""SELECT o_orderkey, o_custkey FROM orders WHERE {_DAY} LIKE '1997%' ORDER BY o_orderdate,
            o_orderkey LIMIT 1""",
        "years_between": """SELECT strftime(o_orderdate, '%Y') AS year, o_orderstatus, count(*) AS orders FROM orders
            WHERE strftime(o_orderdate, '%Y') IN ('1996', '1998') GROUP BY ALL""",
        "count_at_extreme": """SELECT count(p_partkey) AS parts FROM part WHERE p_type <> 'SMALL' AND p_size = (SELECT
            max(p_size) FROM part WHERE p_type <> 'SMALL')""",
        "distinct_at_extreme": """SELECT DISTINCT c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE
            o_orderstatus = (SELECT max(o_orderstatus) FROM orders)""",
        "truthy_filter": """SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE l_discount * 100
            <> 0 AND l_quantity = (SELECT min(l_quantity) FROM lineitem)""",
        "text_number_match": "SELECT p_type, count(*) AS parts FROM part WHERE p_brand = 'Brand#11' GROUP BY ALL",
    }
