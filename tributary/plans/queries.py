"""Registered queries: every operator over the whole of the given tables.

Arrays are printed as space-joined text and sums are rounded, so that results can be compared
across engines; the operators themselves return arrays and unrounded doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import columns as C
from tributary.functions.local import local_table
from tributary.operators import evaluate, layout, masking, normalize, report, sequence, split, stats, tokens
from tributary.operators.discretize import BinEdges, MedianCodes, MedianTree
from tributary.operators.layout import EntityLayout
from tributary.operators.split import HashSplit
from tributary.plans.datasets import ACTIVITY, CHURN
from tributary.plans.jobs import Encoder, sequence_table, text_table
from tributary.schema import EventSchema
from tributary.sources import runs, tables
from tributary.sources.shared import shared_folder

SEED = 42
LENGTH = 10
CLASSES = ["click", "error", "purchase", "signup", "view"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(ids: Column | str) -> Column:
    """An array as space-joined text."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(c.cast("array<string>"), " ")


def stamp(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")


def activity(spark, sf_dir) -> DataFrame:
    """Normalised events."""
    return ACTIVITY.normalise(table(spark, sf_dir, "events"))


def laid_out(spark, sf_dir) -> tuple[DataFrame, EntityLayout]:
    """Normalised events and their layout."""
    return ACTIVITY.normalise_with_layout(table(spark, sf_dir, "events"))


def lines(spark, sf_dir) -> DataFrame:
    """Order lines with their customer, the sub-entity being the line number."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


# --- normalisation -----------------------------------------------------------------------

def time_gaps(spark, sf_dir):
    events = normalize.add_time(table(spark, sf_dir, "events"), F.col("ts"))
    fitted = EntityLayout.fit(events, ["user_id"], ["ts", "event_id"])
    return layout.with_gap(events, fitted).select(
        "user_id", "event_id", "total_minutes", F.col("Hour").cast("bigint").alias("hour_of_day"),
        "total_minutes_from_last")


def time_gaps_cut(spark, sf_dir):
    """The same gaps with every user of more than 20 events cut into cells."""
    events = normalize.add_time(table(spark, sf_dir, "events"), F.col("ts"))
    fitted = EntityLayout.fit(events, ["user_id"], ["ts", "event_id"], split_rows=20)
    return layout.with_gap(events, fitted).select(
        "user_id", "event_id", "total_minutes", F.col("Hour").cast("bigint").alias("hour_of_day"),
        "total_minutes_from_last")


def _minutes(spark, sf_dir) -> DataFrame:
    """Events with a text order: the kind of event, then its number as text."""
    events = normalize.add_time(table(spark, sf_dir, "events"), F.col("ts"))
    return events.withColumn("number", F.col("event_id").cast("string"))


def time_gaps_by_text(spark, sf_dir):
    """Gaps of events ordered by texts, every user of more than 20 events cut into cells of about 5."""
    events = _minutes(spark, sf_dir)
    fitted = EntityLayout.fit(events, ["user_id"], ["event_type", "number"], split_rows=20, cell_rows=5)
    return layout.with_gap(events, fitted).select("user_id", "event_id", "total_minutes_from_last")


def last_event_of_a_day(spark, sf_dir):
    """The last event per day hidden, all events of a day at one time; days of more than 10 events are cut into cells of about 5."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), "event_id", "event_type", "props")
    events = events.withColumn("time", F.to_date("day"))
    fitted = EntityLayout.fit(events, ["day"], ["time", "event_id"], split_rows=10, cell_rows=5)
    return layout.mask_last_event(events, fitted, ["event_type", "props"]).drop("time")


MODES = {"top_flag": "l_returnflag", "top_priority": "o_orderpriority"}


def _rounded(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def entity_stats(spark, sf_dir):
    out = stats.entity_stats(lines(spark, sf_dir), ["o_custkey", "l_linenumber"], "l_quantity", MODES)
    return _rounded(out, "avg_dollar_amt", "std_dollar_amt", digits=6)


def dataset_stats(spark, sf_dir):
    out = stats.dataset_stats(lines(spark, sf_dir), "l_quantity", MODES)
    return _rounded(out, "avg_dollar_amt", "std_dollar_amt", digits=6)


def entity_stats_joined(spark, sf_dir):
    current = lines(spark, sf_dir)
    history = current.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    out = stats.join_entity_stats(current, history, ["o_custkey", "l_linenumber"], "l_quantity", MODES)
    return _rounded(out, "avg_dollar_amt", "std_dollar_amt", digits=6).select(
        *LINE_KEY, "o_custkey", "avg_dollar_amt", "std_dollar_amt", *MODES)


TYPED = EventSchema(index=["l_orderkey"], tie=["l_linenumber"], categorical=["l_quantity", "l_discount", "o_orderpriority"],
                    numeric=["l_extendedprice"], binary=["is_final", "answer"], label=["l_linestatus"],
                    raw=["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag",
                         "l_linestatus", "o_orderpriority"])


def typed_columns(spark, sf_dir):
    raw = normalize.select_raw(lines(spark, sf_dir), TYPED)
    raw = raw.withColumns({"is_final": F.col("l_linestatus") == "F",
                           "answer": F.when(F.col("l_returnflag") == "A", "Yes")
                           .when(F.col("l_returnflag") == "N", "no").otherwise("Returned")})
    clean = normalize.clean_categories(normalize.convert_types(raw, TYPED), TYPED)
    return normalize.select_data(clean, TYPED, ["l_linenumber"])


def rejected_numbers(spark, sf_dir):
    orders = normalize.strip_names(table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias(" priority "), F.left("o_orderpriority", F.lit(1)).alias("rank ")))
    return normalize.rejected_numbers(orders, ["priority", "rank"])


def money_parse(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(
        F.lit("$"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("price"))
    return part.select("p_partkey", C.money(F.col("price")).alias("amount"),
                       F.round(C.money(F.col("price"), log_scale=True), 9).alias("log_amount"))


def timestamp_parse(spark, sf_dir):
    d = F.col("o_orderdate")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("Year"), F.month(d).alias("Month"), F.day(d).alias("Day"),
        F.date_format(d, "HH:mm").alias("Time"), F.upper(F.date_format(d, "ddMMMyy:HH:mm:ss")).alias("compact"),
        C.epoch_seconds(d).alias("seconds"))
    ymd = [F.col("Year"), F.col("Month"), F.col("Day")]
    return orders.select(
        "o_orderkey", stamp(C.clock_timestamp(*ymd, F.col("Time"))).alias("from_parts"),
        stamp(C.clock_timestamp(*ymd, hour=F.col("Day") % 24)).alias("from_hour"),
        stamp(C.clock_timestamp(*ymd)).alias("from_date"),
        stamp(C.compact_timestamp(F.col("compact"))).alias("from_compact"),
        stamp(C.epoch_timestamp(F.col("seconds"))).alias("from_seconds"),
        C.epoch_minutes(C.epoch_timestamp(F.col("seconds"))).alias("minutes"))


def value_mapping(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status = {"F": "finished", "O": "open"}
    return orders.select(
        "o_orderkey", C.mapped(F.col("o_orderstatus"), status, F.lit("other")).alias("status"),
        C.mapped(F.col("o_orderstatus"), status).alias("strict_status"),
        F.when(F.col("o_totalprice") > 200000, "T").otherwise("F").alias("large"),
        C.equals_flag(F.col("o_orderpriority"), "1-URGENT").cast("int").alias("urgent"),
        C.without_whitespace(F.col("o_orderpriority")).alias("priority"))


def suffix_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", C.last_chars(F.col("c_name")).alias("suffix"),
        C.joined([F.col("c_mktsegment"), F.col("c_nationkey"), F.when(F.col("c_acctbal") > 0, "credit")]).alias("joined"))


def equality_filter(spark, sf_dir):
    return report.where_equal(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="5-LOW").select(
        "o_orderkey", "o_custkey")


def flatten_struct(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(
        F.col("o_custkey").alias("customer"),
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("state")).alias("o"))
    return normalize.flatten_struct(orders)


def masked_last_event(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "props")
    fitted = EntityLayout.fit(events, ["user_id"], ["ts", "event_id"])
    return layout.mask_last_event(events, fitted, ["event_type", "props"]).drop("ts")


def churn_rows(spark, sf_dir):
    """Order lines in the layout of raw account histories, written, scanned and normalised; the account becomes the entity key."""
    folder, line = shared_folder(spark), lines(spark, sf_dir)
    raw = line.select(
        F.col("l_orderkey").cast("string").alias("PERIOD"), F.col("o_custkey").cast("bigint").alias("cl_id"), F.col("l_linenumber").cast("int").alias("MCC"),
        F.col("l_linestatus").alias("channel_type"), F.col("l_suppkey").cast("int").alias("currency"),
        F.upper(F.date_format("l_shipdate", "ddMMMyy:HH:mm:ss")).alias("TRDATETIME"), F.col("l_extendedprice").alias("amount"),
        F.col("o_orderpriority").alias("trx_category"), (F.col("l_returnflag") == "R").cast("int").alias("target_flag"), F.col("l_tax").alias("target_sum"))
    raw.write.option("header", True).option("sep", CHURN.sep).csv(f"{folder}/raw")
    found = tables.read_events(spark, f"{folder}/raw", CHURN.fmt, CHURN.read_schema, CHURN.sep)
    found = found.withColumn("line_no", F.concat_ws("-", "PERIOD", "MCC", "currency", "amount"))
    return CHURN.normalise(found).drop("line_no")


# --- profile -----------------------------------------------------------------------------

def profile(spark, sf_dir):
    return stats.profile(activity(spark, sf_dir), ACTIVITY.schema, 5).withColumn("value", F.round("value", 6))


def distinct_counts(spark, sf_dir):
    out = stats.distinct_counts(table(spark, sf_dir, "orders").drop("o_totalprice"))
    return out.withColumn("columns", F.col("columns").cast("bigint"))


def binary_rule(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return stats.binary_violations(labels, ["quality", "toxic", "lang", "source"])


def events_per_year(spark, sf_dir):
    out = stats.events_per_year(table(spark, sf_dir, "orders"), F.col("o_orderdate"))
    return out.withColumn("year", F.col("year").cast("bigint"))


# --- discretisation ----------------------------------------------------------------------

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def median_codes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_shipdate", *MEASURES)
    return MedianCodes.fit(items, MEASURES, 5).transform(items).drop("l_shipdate")


def median_thresholds(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(*MEASURES)
    out = MedianCodes.fit(items, MEASURES, 5).table(spark)
    return out.select("column", "path", F.round("threshold", 6).alias("threshold"), F.col("is_leaf").cast("int").alias("is_leaf"))


def median_codes_unlimited(spark, sf_dir):
    """Codes that are split until nothing can be split any more."""
    items = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_extendedprice", "l_quantity")
    return MedianTree.fit(items, ["l_extendedprice", "l_quantity"]).transform(items)


def median_codes_unseen(spark, sf_dir):
    """Codes of all prices from the tree of those before 1997: new prices fall between the known ones or beyond them."""
    items = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_shipdate", "l_extendedprice")
    early = items.where(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return MedianTree.fit(early, ["l_extendedprice"]).transform(items).drop("l_shipdate")


def event_codes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return MedianCodes.fit(events, ["value"], 5).transform(events).withColumnRenamed("value", "code")


def uniform_bins(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(*LINE_KEY, *MEASURES)
    return BinEdges.uniform(items, MEASURES, 7).transform(items)


def quantile_bins(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(*LINE_KEY, *MEASURES)
    return BinEdges.quantile(items, MEASURES, 8).transform(items)


def apply_bins(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_shipdate", *MEASURES)
    early = items.where(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return BinEdges.quantile(early, MEASURES, 8).transform(items, fitted=False).drop("l_shipdate")


def bin_edges(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(*MEASURES)
    fitted = BinEdges.quantile(items, MEASURES, 8).table(spark)
    return fitted.select("column", F.col("edge_ix").cast("bigint").alias("edge_ix"), F.round("edge", 6).alias("edge"))


def zscore(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(*LINE_KEY, *MEASURES)
    return _rounded(stats.zscore(items, MEASURES), *MEASURES, digits=6)


# --- tokens ------------------------------------------------------------------------------

def _tokens(spark, sf_dir) -> DataFrame:
    events = activity(spark, sf_dir)
    coded = MedianCodes.fit(events, ACTIVITY.schema.numeric, 5).transform(events)
    return tokens.cell_tokens(coded, ACTIVITY.schema)


def cell_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("event_id", *ACTIVITY.schema.data_cols)


def row_text(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return t.select("user_id", "event_id", tokens.row_text(t, ACTIVITY.schema).alias("text"))


def row_text_named(spark, sf_dir):
    return tokens.named_row_text(activity(spark, sf_dir), ACTIVITY.schema).select("user_id", "event_id", "text")


PLAIN = EventSchema(index=["user_id"], tie=["event_id"], categorical=["event_type", "day"], numeric=[], label=["day"])


def _plain(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("user_id", "event_id", "event_type", F.date_format("ts", "MM-dd").alias("day"))


def separator_tokens(spark, sf_dir):
    return tokens.with_separators(_plain(spark, sf_dir), ["event_type", "day"]).select("event_id", text("tokens").alias("tokens"))


def composite_token(spark, sf_dir):
    return tokens.composite_token(_plain(spark, sf_dir), PLAIN)


def atomic_layout(spark, sf_dir):
    return tokens.atomic_layout(_plain(spark, sf_dir), PLAIN)


def record_output(spark, sf_dir):
    out = tokens.records(_plain(spark, sf_dir), PLAIN, keep=["event_id"])
    return out.select("event_id", F.col("metadata.user_id").alias("user_id"), "text", F.col("labels.day").alias("label"))


def vocabulary(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    fitted = tokens.fit_vocabulary(t, tokens.token_array(t, ACTIVITY.schema))
    return fitted.select("token", F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("col_id"), F.lit(-1)).cast("bigint").alias("col_id"),
                         F.coalesce("value", F.lit("")).alias("value"), "freq")


def column_vocabulary(spark, sf_dir):
    fitted = tokens.fit_column_vocabulary(_tokens(spark, sf_dir), ACTIVITY.schema.data_cols)
    return fitted.select("token", F.col("id").cast("bigint").alias("id"))


def tokens_by_column(spark, sf_dir):
    fitted = tokens.tokens_by_column(_encoder(spark, sf_dir).vocabulary)
    return fitted.select(F.col("col_id").cast("bigint").alias("col_id"), "value", F.col("id").cast("bigint").alias("id"))


def label_options(spark, sf_dir):
    out = tokens.label_options(_encoder(spark, sf_dir).vocabulary)
    return out.select(*[F.col(c) if c == "value" else F.col(c).cast("bigint").alias(c) for c in out.columns])


def vocabulary_metrics(spark, sf_dir):
    out = tokens.vocabulary_metrics(_encoder(spark, sf_dir).vocabulary)
    return out.withColumn("is_initialized", F.col("is_initialized").cast("int"))


def _encoder(spark, sf_dir, events: DataFrame | None = None, size: int = tokens.VOCABULARY_SIZE) -> Encoder:
    return Encoder.fit(activity(spark, sf_dir) if events is None else events, ACTIVITY.schema, size=size, persist=True)


def encoded_rows(spark, sf_dir):
    events = activity(spark, sf_dir)
    return _encoder(spark, sf_dir, events).encode(events).select("user_id", "event_id", text("input_ids").alias("input_ids"))


def encoded_unknowns(spark, sf_dir):
    """A vocabulary of 60 entries: rarer tokens become [UNK]."""
    events = activity(spark, sf_dir)
    return _encoder(spark, sf_dir, events, 60).encode(events).select("event_id", text("input_ids").alias("input_ids"))


def encoder_reload(spark, sf_dir):
    """Rows encoded by an encoder that was saved and loaded again."""
    events, folder = activity(spark, sf_dir), shared_folder(spark)
    _encoder(spark, sf_dir, events).save(folder)
    loaded = Encoder.load(spark, folder, ACTIVITY.schema)
    return loaded.encode(events).select("user_id", "event_id", text("input_ids").alias("input_ids"))


def decoded_rows(spark, sf_dir):
    events = activity(spark, sf_dir)
    encoder = _encoder(spark, sf_dir, events, 60)
    out = tokens.decode_ids(encoder.encode(events).select("event_id", "input_ids"), encoder.vocabulary, ["event_id"])
    return out.select("event_id", text("tokens").alias("tokens"))


def change_points(spark, sf_dir):
    items = lines(spark, sf_dir).select(*LINE_KEY, "l_shipdate", "o_custkey", "l_returnflag", "o_orderpriority")
    fitted = EntityLayout.fit(items, ["o_custkey"], LINE_ORDER)
    out = layout.change_points(items, fitted, ["l_returnflag", "o_orderpriority"])
    return out.select("o_custkey", *LINE_KEY, text("changed").alias("changed"))


def change_points_cut(spark, sf_dir):
    """The same change points with every customer of more than 20 lines cut into cells."""
    items = lines(spark, sf_dir).select(*LINE_KEY, "l_shipdate", "o_custkey", "l_returnflag", "o_orderpriority")
    fitted = EntityLayout.fit(items, ["o_custkey"], LINE_ORDER, split_rows=20)
    out = layout.change_points(items, fitted, ["l_returnflag", "o_orderpriority"])
    return out.select("o_custkey", *LINE_KEY, text("changed").alias("changed"))


def interleaved_words(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus")
    out = tokens.words_in_order(orders, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], items,
                                ["l_returnflag", "l_linestatus"])
    return out.select("o_orderkey", F.col("src").cast("bigint").alias("src"), F.col("col_ix").cast("bigint").alias("col_ix"), "word")


# --- splits ------------------------------------------------------------------------------

def entity_split(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    return HashSplit.fit(events, ["user_id"], 0.1, SEED).transform(events)


def row_split(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    return HashSplit.fit(events, ["event_id"], 0.1, SEED, distinct=False).transform(events)


def split_overlap(spark, sf_dir):
    tagged = row_split(spark, sf_dir)
    return split.shared_keys(split.keep_split(tagged, "train"), split.keep_split(tagged, "test"), "user_id")


def restored_split(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    manifest = HashSplit.fit(events, ["user_id"], 0.1, SEED).manifest(events)
    kept = split.restore_split(events, manifest, ["user_id"])
    rest = split.not_in_keys(events, split.keep_split(manifest, "test"), ["user_id"])
    return kept.withColumn("side", F.lit("test")).unionByName(rest.withColumn("side", F.lit("train")))


def manifest_roundtrip(spark, sf_dir):
    """The split restored from a manifest that was written and read again."""
    events, folder = table(spark, sf_dir, "events").select("user_id", "event_id"), shared_folder(spark)
    tables.write_split_manifest(HashSplit.fit(events, ["user_id"], 0.1, SEED).manifest(events), f"{folder}/manifest")
    manifest = tables.read_dataset(spark, f"{folder}/manifest")
    kept = split.restore_split(events, manifest, ["user_id"])
    rest = split.not_in_keys(events, split.keep_split(manifest, "test"), ["user_id"])
    return kept.withColumn("side", F.lit("test")).unionByName(rest.withColumn("side", F.lit("train")))


def stored_manifests(spark, sf_dir):
    """Splits of five runs, some stored in the present layout, others in the old one without masking shares, read in one scan."""
    folder, events = shared_folder(spark), table(spark, sf_dir, "events").select("user_id", "event_type")
    name = C.mapped(F.col("event_type"), {"click": "always_click", "error": "sometimes_randomize_error", "view": "randomize_view"}, F.col("event_type"))
    users = events.select(name.alias("run"), "user_id").distinct()
    split_of = HashSplit.fit(users, ["user_id"], 0.1, SEED).transform(users)
    old = F.col("run").isin("always_click", "sometimes_randomize_error", "view")
    new = split_of.where(~old).withColumns({"saved_name": F.concat(F.lit("saved_"), "run"), "randomize_order": F.lit(False),
                                            "mask_all_pct": F.lit(0.5), "mask_each_pct": F.lit(0.125)})
    tables.write_stored_split(new, f"{folder}/runs", "user_id", 100)
    tables.write_stored_split(split_of.where(old), f"{folder}/runs", "user_id", 100, old_names=True)
    found = tables.read_run_settings(spark, f"{folder}/runs")
    keep = ["run", "saved_name", "randomize_order", "mask_all_pct", "mask_each_pct"]
    out = tables.stored_manifest_ids(found, keep)
    return out.select(*keep[:2], F.col(keep[2]).cast("int").alias(keep[2]), *keep[3:], F.col("key").cast("bigint").alias("user_id"), "split")


def entity_layout(spark, sf_dir):
    """Events laid out by user and time, written and read again."""
    events, folder = table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), shared_folder(spark)
    tables.write_dataset(split.spread_by_entity(events, "user_id", ["ts", "event_id"]), f"{folder}/events")
    return tables.read_dataset(spark, f"{folder}/events").select("user_id", "event_id", stamp(F.col("ts")).alias("ts"))


def run_ranges(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    return layout.run_ranges(events, EntityLayout(["user_id"], ["event_id"]))


# --- sequences ---------------------------------------------------------------------------

def _sequences(spark, sf_dir, **options) -> DataFrame:
    events, fitted = laid_out(spark, sf_dir)
    return sequence_table(events, _encoder(spark, sf_dir, events), LENGTH, seed=SEED, layout=fitted, **options)


def _printed(seqs: DataFrame, *arrays: str) -> DataFrame:
    return seqs.select("user_id", F.col("seq_idx").cast("bigint").alias("seq_idx"), *[text(a).alias(a) for a in arrays])


def sequences(spark, sf_dir):
    out = _sequences(spark, sf_dir)
    return out.select("user_id", F.col("seq_idx").cast("bigint").alias("seq_idx"), "split",
                      F.col("n_rows").cast("bigint").alias("n_rows"), text("input_ids").alias("input_ids"))


def sequence_mask(spark, sf_dir):
    out = _sequences(spark, sf_dir).withColumn("attention", sequence.attention(F.col("input_ids")))
    return _printed(out, "mask", "attention")


def shuffled_columns(spark, sf_dir):
    return _printed(_sequences(spark, sf_dir, randomize=True), "input_ids", "mask")


def pinned_label(spark, sf_dir):
    return _printed(_sequences(spark, sf_dir, randomize=True, fixed=0, label="event_type", moved_to=1), "input_ids", "mask")


def next_token_labels(spark, sf_dir):
    out = _sequences(spark, sf_dir).withColumns({
        "labels": sequence.next_token_labels(F.col("input_ids")),
        "plain_labels": sequence.same_length_labels(F.col("input_ids"))})
    return _printed(out, "labels", "plain_labels")


def text_sequences(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    fitted = EntityLayout.fit(turns, ["conv_id"], ["turn"])
    out = sequence.text_sequences(layout.with_ordinal(turns, fitted), "conv_id", 3)
    return out.select("conv_id", F.col("seq_idx").cast("bigint").alias("seq_idx"),
                      F.col("n_rows").cast("bigint").alias("n_rows"), "text")


def wide_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    fitted = EntityLayout.fit(events, ["user_id"], ["ts", "event_id"])
    out = sequence.wide_events(layout.with_ordinal(events, fitted), "user_id", 5, ["event_type", "value"])
    out = out.withColumn("seq_idx", F.col("seq_idx").cast("bigint"))
    return out.toDF(*[c.replace("Event ", "e").replace(".", "_") for c in out.columns])


def corpus_size(spark, sf_dir):
    return stats.corpus_size(_sequences(spark, sf_dir), "user_id", "n_rows", "input_ids")


# --- masking -----------------------------------------------------------------------------

def masked_tokens(spark, sf_dir):
    events, fitted = laid_out(spark, sf_dir)
    encoder = _encoder(spark, sf_dir, events)
    seqs = sequence_table(events, encoder, LENGTH, seed=SEED, layout=fitted)
    out = masking.masked_tokens(seqs, ["user_id", "seq_idx"], encoder.vocabulary.count(), SEED)
    return _printed(out, "input_ids", "labels")


def masked_labels(spark, sf_dir):
    schema = ACTIVITY.schema
    out = masking.masked_labels(_sequences(spark, sf_dir), ["user_id", "seq_idx"], schema.label_position(),
                                schema.n_cols, SEED, 0.25, 0.5)
    return out.select("user_id", F.col("seq_idx").cast("bigint").alias("seq_idx"),
                      F.col("n_masked").cast("bigint").alias("n_masked"), text("input_ids").alias("input_ids"))


def target_positions(spark, sf_dir):
    label = ACTIVITY.schema.label_position()
    out = masking.target_positions(_sequences(spark, sf_dir), label, "labels", out="label_positions")
    out = masking.target_positions(out, label, "last", out="last_position")
    out = out.withColumn("label_mask", masking.label_mask(F.col("mask"), label))
    return _printed(out, "label_positions", "last_position", "label_mask")


# --- evaluation --------------------------------------------------------------------------

LABEL = ACTIVITY.schema.label_position()


def _groups(spark) -> DataFrame:
    return evaluate.class_groups(spark, ACTIVITY.consolidate, ACTIVITY.schema.col_ids)


def _classes(spark, sf_dir) -> DataFrame:
    """Classes of the label and of the flag before it, in the order of a vocabulary over these two columns, with their groups."""
    cells = ACTIVITY.prepare(table(spark, sf_dir, "events")).select(
        F.concat(F.lit(f"{LABEL}_"), "event_type").alias("label"), F.concat(F.lit(f"{LABEL - 1}_"), C.boolean_text(F.col("is_error"))).alias("flag"))
    vocabulary = tokens.pinned(tokens.fit_vocabulary(cells, F.array("label", "flag")))
    return evaluate.class_order(vocabulary, _groups(spark))


def class_table(spark, sf_dir):
    """Classes and groups of all columns out of a fitted encoder's vocabulary."""
    found = evaluate.class_order(_encoder(spark, sf_dir).vocabulary, _groups(spark))
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in ("col_id", "class_ix", "id")], "value",
                        F.coalesce("group_ix", F.lit(-1)).cast("bigint").alias("group_ix"))


def group_mismatches(spark, sf_dir):
    """What a consolidation map that lacks a value of the label, and has one too many, does not cover."""
    groups = evaluate.class_groups(spark, {"event_type": {"click": 0, "error": 1, "view": 0, "signup": 1, "refund": 1}}, ACTIVITY.schema.col_ids)
    found = evaluate.group_mismatches(_classes(spark, sf_dir), groups)
    return found.select(F.col("col_id").cast("bigint").alias("col_id"), "value", "problem")


def _column_classes(classes: DataFrame, col_id: int) -> tuple[list[str], list[int]]:
    """Values and groups of one column's classes, in class order: what a model's output layer is made of."""
    rows = classes.where(F.col("col_id") == col_id).orderBy("class_ix").collect()
    return [r["value"] for r in rows], [r["group_ix"] for r in rows]


def _labels(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    fitted = EntityLayout.fit(events, ["user_id"], ["ts", "event_id"])
    rows = layout.with_ordinal(events, fitted)
    return rows.withColumn("seq_idx", sequence.chunk_index(F.col("pos"), LENGTH))


def _with_hashed_probs(rows: DataFrame, col_id: int, target: Column, values: list[str], out: str = "probs") -> DataFrame:
    """Add a reproducible stand-in for a model's output that prefers the true class.

    Each step is a column that later ones name more than once, so the optimizer keeps them apart: a row costs one digest per class and
    one more, all in generated code. Inside a lambda they would be interpreted; a filter on the result would be pushed below and repeat them.
    """
    key, likes, total = f"__key_{out}", f"__likes_{out}", f"__total_{out}"
    weights = [f"__w{i}_{out}" for i in range(len(values))]

    def weight(v: str) -> Column:
        return F.lit(1.0) + C.uniform(F.col(key), F.lit(v), F.lit(SEED)) * 9 + F.when(F.col(likes) & (target == v), 5.0).otherwise(0.0)
    steps = rows.withColumn(key, F.concat_ws("|", "user_id", "seq_idx", "pos", F.lit(str(col_id))))
    steps = steps.withColumn(likes, C.uniform(F.col(key), F.lit("hit"), F.lit(SEED)) < 0.6)
    steps = steps.select(*rows.columns, *[weight(v).alias(w) for v, w in zip(values, weights)])
    steps = steps.withColumn(total, sum(map(F.col, weights), F.lit(0.0)))
    # Without classes an empty array of doubles, but no constant: an index into it would be folded, and fail without any row.
    shares = F.array(*[F.round(F.col(w) / F.col(total), 6) for w in weights]) if weights else F.slice(F.array(F.col("pos").cast("double")), 1, 0)
    return steps.select(*rows.columns, shares.alias(out))


def label_scores(spark, sf_dir) -> DataFrame:
    """One scored row per event for the label column."""
    return _label_scores(spark, sf_dir)[0]


def _label_scores(spark, sf_dir) -> tuple[DataFrame, list[int]]:
    """The scores, and the group of each class."""
    classes = _classes(spark, sf_dir)
    values, groups = _column_classes(classes, LABEL)
    rows = _labels(spark, sf_dir).select("user_id", "seq_idx", "pos", F.lit(LABEL).alias("col_id"), F.col("event_type").alias("target"))
    return evaluate.with_class(_with_hashed_probs(rows, LABEL, F.col("target"), values), classes), groups


def _variants(spark, sf_dir) -> DataFrame:
    scores, groups = _label_scores(spark, sf_dir)
    return evaluate.known_targets(evaluate.metric_variants(scores, ["user_id", "seq_idx"], groups))


def accuracy_variants(spark, sf_dir):
    return evaluate.accuracy(_variants(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


def _auc(spark, sf_dir) -> DataFrame:
    scores, groups = _label_scores(spark, sf_dir)
    return evaluate.scores_auc(scores, ["user_id", "seq_idx"], groups)


def auc_ovr(spark, sf_dir):
    return _auc(spark, sf_dir).select("variant", F.col("class_ix").cast("bigint").alias("class_ix"), "positives", "negatives",
                                      F.round("auc", 9).alias("auc"))


def auc_macro(spark, sf_dir):
    return evaluate.macro_auc(_auc(spark, sf_dir)).withColumn("auc", F.round("auc", 9))


def f1_scores(spark, sf_dir):
    return _rounded(evaluate.f1(_variants(spark, sf_dir)), "f1_micro", "f1_macro", "f1_weighted", digits=9)


def binary_f1(spark, sf_dir):
    return _rounded(evaluate.binary_f1(_variants(spark, sf_dir)), "f1_binary", digits=9)


def column_accuracy(spark, sf_dir):
    rows, classes = _labels(spark, sf_dir), _classes(spark, sf_dir)
    (values, groups), (flags, _) = (_column_classes(classes, c) for c in (LABEL, LABEL - 1))
    is_error = C.boolean_text(F.col("event_type") == "error")
    rows = _with_hashed_probs(rows, LABEL, F.col("event_type"), values, "label_probs")
    rows = _with_hashed_probs(rows, LABEL - 1, is_error, flags, "flag_probs")
    both = F.array(
        F.struct(F.lit(LABEL).alias("col_id"), F.col("event_type").alias("target"), F.col("label_probs").alias("probs")),
        F.struct(F.lit(LABEL - 1).alias("col_id"), is_error.alias("target"), F.col("flag_probs").alias("probs")))
    scored = rows.select("user_id", F.explode(both).alias("s")).select("user_id", "s.*")
    out = evaluate.with_overall(evaluate.column_accuracy(evaluate.with_class(scored, classes), {LABEL: groups}))
    return out.select(F.col("col_id").cast("bigint").alias("col_id"), "rows", F.round("accuracy", 9).alias("accuracy"))


def consolidated_metrics(spark, sf_dir):
    scores, groups = _label_scores(spark, sf_dir)
    grouped = evaluate.group_probabilities(F.col("probs"), groups)
    out = scores.select("user_id", "pos", F.col("group_ix").cast("bigint").alias("group_ix"), grouped.alias("g"))
    return out.select("user_id", "pos", "group_ix", F.round(F.col("g")[0], 9).alias("p0"), F.round(F.col("g")[1], 9).alias("p1"))


def _logits(targets: DataFrame) -> DataFrame:
    """Arithmetic stand-in for the model's output over a vocabulary of 12 ids."""
    value = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (
        (i * 7 + F.col("pos") * 13 + F.col("user_id") * 5) % 23).cast("double") / 4.0)
    return targets.select("user_id", "seq_idx", "pos", value.alias("logits"))


def _softmax(spark, sf_dir, **options) -> DataFrame:
    """Compact sequences of two cells per event (label id, row marker) aligned and scored."""
    rows = _labels(spark, sf_dir)
    groups = ACTIVITY.consolidate["event_type"]
    ids = F.array(C.mapped(F.col("event_type"), {v: i + 6 for i, v in enumerate(CLASSES)}).cast("int"), F.lit(5))
    seqs = sequence.sequences(rows.withColumn("input_ids", ids), "user_id", LENGTH, 2)
    targets = evaluate.aligned_targets(seqs, ["user_id", "seq_idx"], 0)
    classes = local_table(spark, [(0, i, v, i + 6, groups[v]) for i, v in enumerate(CLASSES)], evaluate.CLASS_SCHEMA)
    out = evaluate.softmax_scores(targets, _logits(targets), classes, ["user_id", "seq_idx"], **options)
    return out.select("user_id", F.col("seq_idx").cast("bigint").alias("seq_idx"), F.col("pos").cast("bigint").alias("pos"),
                      F.col("target_ix").cast("bigint").alias("target_ix"),
                      *[F.round(F.col("probs")[i], 9).alias(f"p{i}") for i in range(len(CLASSES))])


def softmax_scores(spark, sf_dir):
    return _softmax(spark, sf_dir)


def softmax_scores_spread(spark, sf_dir):
    """The same scores where class lists are taken as too large to broadcast."""
    return _softmax(spark, sf_dir, rows=1)


def softmax_check(spark, sf_dir):
    """Scores whose rounded probabilities miss 1 by more than the tolerance."""
    loose = evaluate.probability_violations(label_scores(spark, sf_dir), 1e-6)
    return loose.select("user_id", "pos", F.round("total", 6).alias("total"))


def _batches(spark, sf_dir) -> DataFrame:
    scores = label_scores(spark, sf_dir)
    p = F.element_at("probs", F.col("class_ix") + 1)
    hit = (evaluate.predicted_class(F.col("probs")) == F.col("class_ix")).cast("double")
    return scores.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(-F.ln(p)).alias("loss"), F.avg(hit).alias("accuracy"))


def batch_metrics(spark, sf_dir):
    return _rounded(evaluate.gathered_batches(_batches(spark, sf_dir), ["accuracy"]), "loss", "accuracy", digits=9)


def run_row(spark, sf_dir):
    metrics = evaluate.gathered_batches(_batches(spark, sf_dir), ["accuracy"]).withColumn("scratch", F.lit(1))
    settings = {"name": "final_run", "seq_length": LENGTH, "randomize_order": "false"}
    out = evaluate.metric_row(metrics, settings, {"name": "first_run", "seq_length": 5, "lr": 0.1})
    return _rounded(out, "eval_loss", "eval_accuracy", digits=9)


def _prompt_source(spark, sf_dir) -> DataFrame:
    events, fitted = laid_out(spark, sf_dir)
    return text_table(events, ACTIVITY.schema, 5, fitted)


def prompts(spark, sf_dir):
    out = evaluate.prompts(_prompt_source(spark, sf_dir), exclude_labels=True, replace_question="next type")
    return out.select("user_id", F.col("seq_idx").cast("bigint").alias("seq_idx"), "question", "answer",
                      F.col("messages")[1]["content"].alias("user_prompt"),
                      F.col("messages")[2]["content"].alias("assistant_prompt"))


def label_free_text(spark, sf_dir):
    source = _prompt_source(spark, sf_dir)
    return source.select("user_id", F.col("seq_idx").cast("bigint").alias("seq_idx"),
                         masking.without_label_words(F.col("text"), F.lit("event_type")).alias("text"))


# --- reports -----------------------------------------------------------------------------

PRIORITY = {"1-URGENT": "amazon_electronics", "2-HIGH": "amazon_movies", "3-MEDIUM": "ibm",
            "4-NOT SPECIFIED": "loans", "5-LOW": "churn"}


def run_files(spark, sf_dir) -> DataFrame:
    """Metric files derived from orders: one per order, named by priority, status and date."""
    phase = C.mapped(F.col("o_orderstatus"), {"F": "eval", "O": "train"}, F.lit("other"))
    setting = C.mapped(F.col("o_orderstatus"), {"F": "_masked_randomized"}, F.lit(""))
    task = F.concat(F.lit("final_"), C.mapped(F.col("o_orderpriority"), PRIORITY), setting)
    name = F.concat(F.lit("table-"), task, F.lit("-"), F.date_format("o_orderdate", "yyyy-MM-dd-HH-mm"), F.lit("-"),
                    phase, F.lit("_stats.csv"))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("filename"), task.alias("name"))


def parsed_runs(spark, sf_dir):
    out = report.parse_run_files(run_files(spark, sf_dir))
    return out.select("o_orderkey", "task_name", "experiment_name", stamp(F.col("creation_time")).alias("creation_time"),
                      "train_eval", report.experiment_of(F.col("name")).alias("short_name"))


def latest_runs(spark, sf_dir):
    out = report.latest_runs(report.parse_run_files(run_files(spark, sf_dir)), "eval")
    return out.select("task_name", "experiment_name", "filename", stamp(F.col("creation_time")).alias("creation_time"))


def _result_folder(spark, sf_dir) -> str:
    """Result files of runs per priority, status and year, with a row per order: a phase and two statuses, each with columns of its own."""
    folder, d = shared_folder(spark), F.col("o_orderdate")
    phase = F.when(F.col("o_orderstatus") == "O", "train").otherwise("eval")
    setting = F.when(F.col("o_orderstatus") == "F", "_masked_randomized").otherwise("")
    name = F.concat(F.lit("final_"), C.mapped(F.col("o_orderpriority"), PRIORITY), setting)
    file = F.concat(F.lit("table-"), name, F.lit("-"), F.date_format(F.date_trunc("year", d), "yyyy-MM-dd-HH-mm"), F.lit("-"), phase, F.lit("_stats.csv"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderstatus", file.alias("file"), name.alias("name"), F.col("o_orderkey").alias("step"), F.col("o_custkey").alias("rows"),
        F.concat(F.lit('a "b"\t'), "o_orderpriority").alias("note"))
    for status, columns in {"F": ["name", "step", "note"], "O": ["step", "rows", "name"], "P": ["rows", "name", "step"]}.items():
        runs.write_results(rows.where(F.col("o_orderstatus") == status).select("file", *columns), folder, "file")
    return folder


def _result_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"step": F.col("step").cast("bigint"), "rows": F.coalesce(F.col("rows").cast("bigint"), F.lit(-1)), "note": F.coalesce("note", F.lit(""))})


def all_results(spark, sf_dir):
    """All result files of a folder, columns by the names in their own headers."""
    return _result_columns(runs.read_results(spark, _result_folder(spark, sf_dir)))


def latest_results(spark, sf_dir):
    """Rows of the newest evaluation file of every task and experiment."""
    return _result_columns(runs.latest_results(spark, _result_folder(spark, sf_dir), "eval"))


def _run_metrics(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    dataset = F.concat(F.lit("EVAL_pretrain_"), C.mapped(F.col("o_orderpriority"), PRIORITY))
    return orders.select(
        dataset.alias("dataset"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").cast("int").alias("randomized"),
        (F.month("o_orderdate") > 6).cast("int").alias("masking"),
        (F.col("o_totalprice") / 1000000).cast("decimal(12,6)").cast("string").alias("auc_last"),
        F.when(F.col("o_totalprice") > 100000, (F.col("o_totalprice") / 2000000).cast("decimal(12,6)").cast("string"))
        .otherwise("n/a").alias("auc_last_consolidated"))


def _summary(spark, sf_dir) -> DataFrame:
    summary = report.metric_summary(_run_metrics(spark, sf_dir), ["dataset", "randomized", "masking"],
                                    ["auc_last", "auc_last_consolidated"])
    return report.chosen_metric(summary, "dataset", "amazon", "auc_last_consolidated", "auc_last")


def metric_summary(spark, sf_dir):
    out = _summary(spark, sf_dir)
    numbers = [c for c in out.columns if c.endswith(("_mean", "_std"))]
    return _rounded(out, *numbers, digits=9).withColumns(
        {c: F.col(c).cast("bigint") for c in ("randomized", "masking")})


def metric_pivot(spark, sf_dir):
    ibm = report.where_equal(_summary(spark, sf_dir), dataset="EVAL_pretrain_ibm")
    out = report.metric_pivot(ibm, "randomized", "masking", [0, 1], "desired_metric_mean")
    return out.select(F.col("randomized").cast("bigint").alias("randomized"), F.round("0", 9).alias("unmasked"),
                      F.round("1", 9).alias("masked"))


def benchmark_union(spark, sf_dir):
    chosen = report.where_equal(_summary(spark, sf_dir), masking=0)
    ours = chosen.select(report.dataset_name(F.col("dataset")).alias("Dataset"),
                         C.mapped(F.col("randomized"), {1: "Random order", 0: "Fixed order"}).alias("Method"),
                         F.round("desired_metric_mean", 9).alias("Value"), F.round("desired_metric_std", 9).alias("Std"))
    return report.with_published(ours)


def setup_first_rows(spark, sf_dir):
    """First order of every (customer, setup) by date."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate",
        report.setup_key(F.col("o_orderstatus"), F.left("o_orderpriority", F.lit(1))).alias("setup"))
    first = report.keep_first(orders, ["o_custkey", "setup"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return first.select("o_orderkey", "o_custkey", "setup")


def top_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", stamp(F.col("o_orderdate")).alias("day"))
    return report.first_rows(orders, [F.col("o_custkey"), F.col("day"), F.col("o_orderkey")], 25)


# --- sources and sinks -------------------------------------------------------------------

def io_roundtrip(spark, sf_dir):
    """Orders written sorted as CSV, read back, written as Parquet and JSON and read again."""
    base = shared_folder(spark)
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", stamp(F.col("o_orderdate")))
    schema = orders.schema
    tables.write_sorted(orders, f"{base}/csv", ["o_custkey", "o_orderkey"], sep=";")
    tables.write_dataset(tables.read_csv(spark, f"{base}/csv", schema, ";"), f"{base}/parquet")
    tables.write_json(tables.read_dataset(spark, f"{base}/parquet"), f"{base}/json")
    return tables.read_json(spark, f"{base}/json", schema)


def gzip_csv(spark, sf_dir):
    """Orders written as gzipped CSV and scanned."""
    folder, orders = shared_folder(spark), table(spark, sf_dir, "orders").withColumn("o_orderdate", stamp(F.col("o_orderdate")))
    orders.write.option("header", True).option("sep", ";").option("compression", "gzip").csv(f"{folder}/csv")
    return tables.read_events(spark, f"{folder}/csv", "csv", orders.schema, ";")


def archive_member(spark, sf_dir):
    """One member of an unpacked archive, delimited by semicolons, read beside another one with other columns."""
    folder, orders = shared_folder(spark), table(spark, sf_dir, "orders").withColumn("o_orderdate", stamp(F.col("o_orderdate")))
    orders.write.option("header", True).option("sep", ";").csv(f"{folder}/archive/trans.asc")
    orders.select("o_custkey", "o_orderkey").write.option("header", True).option("sep", ";").csv(f"{folder}/archive/loan.asc")
    return tables.read_events(spark, f"{folder}/archive/trans.asc", "csv", orders.schema, ";")


def gzip_json_lines(spark, sf_dir):
    """Orders written as gzipped JSON lines and scanned into eight partitions."""
    folder, orders = shared_folder(spark), table(spark, sf_dir, "orders").withColumn("o_orderdate", stamp(F.col("o_orderdate")))
    orders.write.option("compression", "gzip").json(f"{folder}/json")
    return tables.read_json_lines(spark, f"{folder}/json", orders.schema, 8)


def sample_sink(spark, sf_dir):
    """The first 1,000 orders by key, from the sample that is written for looking at."""
    folder, orders = shared_folder(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    tables.write_sample(orders, f"{folder}/sample", [F.col("o_orderkey")])
    return tables.read_csv(spark, f"{folder}/sample", orders.schema)


def scored_label_sink(spark, sf_dir):
    """Probabilities and label of every event, written as JSON lines and read again."""
    folder = shared_folder(spark)
    scored = label_scores(spark, sf_dir).select("user_id", "pos", "probs", F.col("class_ix").cast("bigint").alias("label"))
    tables.write_json(scored, f"{folder}/scores")
    back = tables.read_json(spark, f"{folder}/scores", scored.schema)
    return back.select("user_id", "pos", "label", *[F.get("probs", F.lit(i)).alias(f"p{i}") for i in range(len(CLASSES))])


def metrics_append(spark, sf_dir):
    """Order totals appended per status, the second batch with an extra column."""
    base = shared_folder(spark)
    orders = table(spark, sf_dir, "orders")
    totals = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    runs.append_metrics(totals, f"{base}/metrics")
    runs.append_metrics(orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key")), f"{base}/metrics")
    return runs.read_metrics(spark, f"{base}/metrics").withColumn("last_key", F.coalesce("last_key", F.lit(-1)))


QUERIES = [
    time_gaps, entity_stats, dataset_stats, entity_stats_joined, typed_columns, rejected_numbers, money_parse,
    timestamp_parse, value_mapping, suffix_keys, equality_filter, flatten_struct, masked_last_event,
    profile, distinct_counts, binary_rule, events_per_year,
    median_codes, median_thresholds, median_codes_unlimited, median_codes_unseen, event_codes, uniform_bins, quantile_bins, apply_bins, bin_edges, zscore,
    cell_tokens, row_text, row_text_named, separator_tokens, composite_token, atomic_layout, record_output,
    vocabulary, column_vocabulary, tokens_by_column, label_options, vocabulary_metrics, encoded_rows,
    encoded_unknowns, decoded_rows, change_points, interleaved_words,
    entity_split, row_split, split_overlap, restored_split, run_ranges,
    sequences, sequence_mask, shuffled_columns, pinned_label, next_token_labels, text_sequences, wide_events,
    corpus_size, masked_tokens, masked_labels, target_positions,
    accuracy_variants, auc_ovr, auc_macro, f1_scores, binary_f1, column_accuracy, consolidated_metrics,
    softmax_scores, softmax_check, batch_metrics, run_row, prompts, label_free_text,
    parsed_runs, latest_runs, metric_summary, metric_pivot, benchmark_union, setup_first_rows, top_rows,
    io_roundtrip, metrics_append, time_gaps_cut, change_points_cut, encoder_reload, manifest_roundtrip, entity_layout,
    gzip_csv, gzip_json_lines, sample_sink, scored_label_sink, churn_rows, stored_manifests, all_results, latest_results,
    time_gaps_by_text, last_event_of_a_day, class_table, group_mismatches, softmax_scores_spread, archive_member,
]
