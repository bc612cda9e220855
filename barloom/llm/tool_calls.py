"""Chat formatting: linking tool calls and results.

Calls and results meet by a hash join on (conversation, call id). Calls are
ordered topologically by levels: a call is one level above the highest call that
it depends on. Arguments are parsed as JSON, checked against the schema of the
tool and written as canonical JSON: keys sorted, no blanks.

Everything is DataFrame functions (variant functions for JSON). No conversation is
ever gathered: levels move along edges, so a conversation with a third of all
rows is spread like any other. Calls of level n are found in round n; the number
of rounds is that of the deepest chain.

Inputs: calls(conv_id, turn, call_id, tool, arguments, depends_on array), results(conv_id,
call_id, turn, content), schemas(tool, field, type, required).

Defined cases: null or broken JSON, and JSON that is no object, give no canonical form and the error
'arguments'. A tool without schema gives 'tool'. Missing required fields, fields of
another type and unknown fields give 'missing:f', 'type:f', 'unknown:f'. A null value
counts as missing. Of several results of a call the first by turn, then by content, is linked
and all are counted. A call id that occurs twice in a conversation gives 'duplicate' to all its
calls; dependencies on it wait for its highest level. Dependencies on ids that do not
exist give 'dependency' and do not hold a call back. Calls in a cycle, and calls that wait for one, have no level and
give 'cycle'. Calls with a null conversation or id link to nothing. Equal rows
are reported each. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import literal_rows
from barloom.sources.scratch import cut

KEYS = ["conv_id", "call_id"]


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls with result (content), result_turn and n_results."""
    first = results.where(F.col("call_id").isNotNull()).groupBy(*KEYS).agg(
        F.min(F.struct("turn", "content")).alias("first_"), F.count(F.lit(1)).alias("n_"))
    out = calls.join(first, KEYS, "left")
    return out.select(*calls.columns, F.col("first_.content").alias("result"), F.col("first_.turn").alias("result_turn"),
                      F.coalesce("n_", F.lit(0)).cast("long").alias("n_results"))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level for distinct calls outside of cycles; level 0 depends on nothing.

    Rounds of a frontier: a call is settled in the round in which its last
    dependency was settled. Each round is written.
    """
    ids = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    nodes = cut(ids.select(*KEYS).distinct(), "calls")
    edges = ids.select(*KEYS, F.explode("depends_on").alias("on")).where(F.col("on").isNotNull()).distinct()
    exists = nodes.select("conv_id", F.col("call_id").alias("on"))
    edges = cut(edges.join(exists, ["conv_id", "on"], "left_semi"), "call-edges")
    waiting = cut(edges.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("open")), "waiting-0")
    settled = cut(nodes.join(waiting, KEYS, "left_anti").withColumn("level", F.lit(0)), "level-0")
    front, n = settled, 0
    while not front.isEmpty():
        n += 1
        freed = front.select("conv_id", F.col("call_id").alias("on")).join(edges, ["conv_id", "on"]).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("freed"))
        waiting = cut(waiting.join(freed, KEYS, "left").select(*KEYS, (F.col("open") - F.coalesce("freed", F.lit(0))).alias("open")).where(F.col("open") >= 0), f"waiting-{n}")
        front = waiting.where(F.col("open") == 0).select(*KEYS, F.lit(n).alias("level"))
        settled = settled.unionByName(front)
        waiting = waiting.where(F.col("open") > 0)
    return settled


def parsed(calls: DataFrame) -> DataFrame:
    """calls with v_ (variant, null if not an object) and canonical (JSON text)."""
    v = F.try_parse_json("arguments")
    out = calls.withColumn("v_", v)
    out = out.withColumn("v_", F.when(F.schema_of_variant("v_").startswith("OBJECT"), F.col("v_")))
    return out.withColumn("canonical", F.to_json("v_"))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """row_, errors: for calls whose object breaks the schema of the tool. calls: row_, tool, v_.

    One row per field of every call meets the schema by a hash join on (tool, field).
    """
    spark = calls.sparkSession
    calls.createOrReplaceTempView("calls_with_variant_")
    fields = spark.sql("SELECT row_, tool, e.key AS field, schema_of_variant(e.value) AS kind FROM calls_with_variant_, LATERAL variant_explode(v_) AS e")
    spark.catalog.dropTempView("calls_with_variant_")
    fields = fields.where(F.col("kind") != "VOID")
    rules = schemas.select("tool", "field", F.upper("type").alias("want"), "required").dropDuplicates(["tool", "field"])
    kind = F.when(F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.when(F.col("kind") == "BIGINT", F.lit("INTEGER")).otherwise(F.lit("NUMBER"))) \
        .otherwise(F.regexp_extract("kind", "^[A-Z]+", 0))
    fits = (kind == F.col("want")) | ((F.col("want") == "NUMBER") & (kind == "INTEGER"))
    seen = fields.join(rules, ["tool", "field"], "left").withColumn("kind", kind)
    wrong = seen.select("row_", F.when(F.col("want").isNull(), F.concat(F.lit("unknown:"), "field"))
                        .when(~fits, F.concat(F.lit("type:"), "field")).alias("error")).where(F.col("error").isNotNull())
    have = fields.select("row_", "field")
    need = calls.where(F.col("v_").isNotNull()).select("row_", "tool").join(rules.where("required").select("tool", "field"), "tool")
    lost = need.join(have, ["row_", "field"], "left_anti").select("row_", F.concat(F.lit("missing:"), "field").alias("error"))
    return wrong.unionByName(lost).groupBy("row_").agg(F.array_sort(F.collect_list("error")).alias("errors_"))


def formatted(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Per call: ids, turn, tool, level, canonical, result, result_turn, n_results, errors (sorted), valid, message.

    message is the canonical JSON of the linked pair, null if the call is not valid.
    """
    calls = calls.select("conv_id", "turn", "call_id", "tool", "arguments", "depends_on")
    rows = cut(calls.withColumn("row_", F.monotonically_increasing_id()), "numbered-calls")
    order = levels(rows)
    twice = rows.where(F.col("call_id").isNotNull()).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("same_"))
    wanted = rows.select("row_", "conv_id", F.explode("depends_on").alias("on")).where(F.col("on").isNotNull())
    exists = rows.select("conv_id", F.col("call_id").alias("on")).distinct()
    loose = wanted.join(exists, ["conv_id", "on"], "left_anti").select("row_").distinct().withColumn("loose_", F.lit(True))
    # Written: row numbers must be the same in all joins.
    args = cut(parsed(rows).select("row_", "tool", "v_", "canonical").withColumn("json_", F.to_json("v_")).drop("v_"), "parsed-calls")
    args = args.withColumn("v_", F.try_parse_json("json_")).drop("json_")
    tools = schemas.select("tool").distinct().withColumn("known_", F.lit(True))
    out = linked(rows, results).join(args.select("row_", "canonical"), "row_") \
        .join(argument_errors(args, schemas), "row_", "left").join(loose, "row_", "left") \
        .join(order, KEYS, "left").join(twice, KEYS, "left").join(tools, "tool", "left")
    also = F.array_compact(F.array(
        F.when(F.col("canonical").isNull(), F.lit("arguments")), F.when(F.col("known_").isNull(), F.lit("tool")),
        F.when(F.col("same_") > 1, F.lit("duplicate")), F.when(F.col("loose_"), F.lit("dependency")),
        F.when(F.col("level").isNull() & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull(), F.lit("cycle")),
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), F.lit("id")),
        F.when(F.col("n_results") == 0, F.lit("no_result"))))
    own = F.when(F.col("known_").isNotNull(), F.col("errors_"))
    errors = F.array_sort(F.concat(also, F.coalesce(own, F.array().cast("array<string>"))))
    out = out.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30)
    text = lambda c: F.regexp_replace(quoted(F.col(c)), r"\]$", "")
    message = F.concat(F.lit('{"arguments":'), "canonical", F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("tool"),
                       F.lit(',"result":'), F.coalesce(text("result"), F.lit("null")), F.lit("}"))
    return out.select("conv_id", "turn", "call_id", "tool", "level", "canonical", "result", "result_turn", "n_results", "errors", "valid",
                      F.when(F.col("valid"), message).alias("message"))


SCHEMAS = [("ask", "query", "string", True), ("ask", "words", "integer", True), ("ask", "first", "boolean", False),
           ("setup", "prompt", "string", True), ("setup", "limit", "integer", True)]


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas that the conversations table stands for.

    A user or system turn is a call, with its text among the arguments; an assistant
    turn is the result of the turn before it. The k-th pair of turns depends on
    pair k / 2, the first user turn on a system turn before it.
    """
    turn = F.col("turn")
    pair = F.floor(turn / 2)
    ask = F.to_json(F.struct(F.size(F.split("text", " ")).alias("words"), (turn == 0).alias("first"), F.col("text").alias("query")))
    setup = F.to_json(F.struct(F.col("text").alias("prompt")))
    name = lambda n: F.concat(F.lit("call_"), n.cast("string"))
    before = F.when(turn == 0, F.lit(None)).when(pair == 0, F.lit(0).cast("long")).otherwise(2 * F.floor(pair / 2) + turn % 2)
    user = F.col("role") == "user"
    calls = messages.where(F.col("role").isin("user", "system")).select(
        "conv_id", "turn", name(turn).alias("call_id"), F.when(user, F.lit("ask")).otherwise(F.lit("setup")).alias("tool"),
        F.when(user, ask).otherwise(setup).alias("arguments"), F.array_compact(F.array(name(before))).alias("depends_on"))
    results = messages.where(F.col("role") == "assistant").select(
        "conv_id", name(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    schemas = literal_rows(messages.sparkSession, SCHEMAS, ["tool", "field", "type", "required"])
    return calls, results, schemas
