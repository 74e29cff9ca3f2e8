"""Survey-shaped views over the driver tables.

The driver ships TPC-H-like tables, not survey microdata.  These views give
them survey meaning (an order is a respondent, its year the wave, its
total price the weight, customer segment / region / balance the
sub-population attributes).  Every view is a lazy DataFrame over the whole
tables, so all downstream work grows with the data.

The small literal tables at the bottom (codebook, group codes, policies,
steering texts) play the part of the survey's metadata files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.operators.joins import bounded_broadcast
from quorum.sources.driver import table


def _sql_lit(v, dtype: T.DataType) -> str:
    if v is None:
        return f"CAST(NULL AS {dtype.simpleString()})"
    if isinstance(dtype, T.ArrayType):
        inner = ", ".join(_sql_lit(x, dtype.elementType) for x in v)
        return f"CAST(array({inner}) AS {dtype.simpleString()})"
    if isinstance(dtype, T.StringType):
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(dtype, T.DoubleType):
        return f"CAST('{float(v)!r}' AS DOUBLE)"
    return f"CAST({v} AS {dtype.simpleString()})"


def literal_table(spark: SparkSession, rows, schema: str | T.StructType) -> DataFrame:
    """A small fixed table as a local relation (``VALUES``): no RDD, no job
    to scan or broadcast it."""
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    cols = [f.name for f in st.fields]
    body = ", ".join("(" + ", ".join(_sql_lit(v, f.dataType) for v, f in zip(r, st.fields)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(cols)})")


# ---------------------------------------------------------------- V1 / V2

def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one row per order = one respondent.

    orders ⋈ customer is the only big join (shuffle on custkey; AQE splits a
    hot customer).  nation (25 rows) and region (5 rows) are fixed-size
    dimension tables, so broadcasting them is bounded by construction.
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = bounded_broadcast(table(spark, sf_dir, "nation"))
    r = bounded_broadcast(table(spark, sf_dir, "region"))
    cust = (c.join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select("c_custkey", "c_mktsegment", "c_acctbal", "n_name", "r_name"))
    return (o.join(cust, o.o_custkey == cust.c_custkey)
             .select(
                 F.col("o_orderkey").alias("human_id"),
                 F.year("o_orderdate").cast("int").alias("wave"),
                 F.when(F.col("o_orderkey") % 31 == 0, F.lit(None).cast("double"))
                  .otherwise(F.col("o_totalprice")).alias("weight"),
                 F.col("c_mktsegment").alias("segment"),
                 F.col("r_name").alias("region"),
                 F.col("n_name").alias("nation"),
                 F.floor(F.col("c_acctbal") / 1000).cast("int").alias("balance_code"),
                 F.col("o_custkey").alias("cust_id"),
                 F.col("o_orderpriority").alias("priority"),
                 F.col("o_orderstatus").alias("status"),
             ))


def _answer_code(human_id, valid_code):
    """NULL every 17th respondent (not asked), -8 every 29th (invalid)."""
    return (F.when(human_id % 17 == 0, F.lit(None).cast("double"))
             .when(human_id % 29 == 0, F.lit(-8.0))
             .otherwise(valid_code.cast("double")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, long form ``(human_id, wave, qkey, var, code, weight, attrs…)``.

    Two questions per respondent: PRIORITY (first digit of the priority,
    4 = "not specified" = refusal) and STATUS (F/O/P -> 1/2/3), keyed
    ``<VAR>_W<wave>``.  Unpivot is one ``explode`` (no second scan).
    """
    return responses_from(respondents(spark, sf_dir))


def responses_from(r: DataFrame) -> DataFrame:
    """V2 built on a given respondents frame (lets callers reuse one)."""
    hid = F.col("human_id")
    prio = F.substring("priority", 1, 1).cast("double")
    stat = (F.when(F.col("status") == "F", 1.0).when(F.col("status") == "O", 2.0)
             .when(F.col("status") == "P", 3.0))
    qa = F.explode(F.array(
        F.struct(F.lit("PRIORITY").alias("var"), _answer_code(hid, prio).alias("code")),
        F.struct(F.lit("STATUS").alias("var"), _answer_code(hid, stat).alias("code")),
    )).alias("qa")
    return (r.select("human_id", "wave", "weight", "segment", "region", "nation",
                     "balance_code", "cust_id", qa)
             .select("human_id", "wave",
                     F.concat(F.col("qa.var"), F.lit("_W"), F.col("wave").cast("string")).alias("qkey"),
                     F.col("qa.var").alias("var"), F.col("qa.code").alias("code"),
                     "weight", "segment", "region", "nation", "balance_code", "cust_id"))


# ---------------------------------------------------------------- V3

LINE_VARS = ("RETURNFLAG", "LINESTATUS", "QTY", "DISCOUNT")


def line_answers(spark: SparkSession, sf_dir: str, segment: bool = False) -> DataFrame:
    """V3, wide: one row per line item = one respondent with four answers.

    human_id = orderkey*8 + linenumber; codes: RETURNFLAG A/N/R -> 1/2/3,
    LINESTATUS F/O -> 1/2, QTY = ceil(quantity/5) (1..10), DISCOUNT =
    round(discount*100) + 1 (1..11); NULL answers on a few key residues.
    With ``segment`` it carries the customer segment for sub-population
    filters, at the price of two joins.
    """
    li = table(spark, sf_dir, "lineitem")
    hid = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rf = (F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0)
           .when(F.col("l_returnflag") == "R", 3.0))
    ls = F.when(F.col("l_linestatus") == "F", 1.0).when(F.col("l_linestatus") == "O", 2.0)
    qty = F.ceil(F.col("l_quantity") / 5).cast("double")
    disc = (F.round(F.col("l_discount") * 100) + 1).cast("double")
    seg = []
    if segment:
        # orders ⋈ customer first (keyed by orderkey afterwards), so lineitem —
        # the largest table — is shuffled once, on its own join key
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        oc = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_mktsegment")
        li, seg = li.join(oc, li.l_orderkey == oc.o_orderkey), [F.col("c_mktsegment").alias("segment")]
    return (li.select(hid.alias("human_id"), *seg,
                      F.when(hid % 13 == 0, F.lit(None).cast("double")).otherwise(rf).alias("RETURNFLAG"),
                      ls.alias("LINESTATUS"),
                      F.when(hid % 11 == 0, F.lit(None).cast("double")).otherwise(qty).alias("QTY"),
                      disc.alias("DISCOUNT")))


def line_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 long form ``(human_id, qkey, code)``; NULL answers dropped."""
    w = line_answers(spark, sf_dir)
    qa = F.explode(F.array(*[F.struct(F.lit(v).alias("qkey"), F.col(v).alias("code"))
                             for v in LINE_VARS])).alias("qa")
    return (w.select("human_id", qa).select("human_id", "qa.qkey", "qa.code")
             .where(F.col("code").isNotNull()))


# ---------------------------------------------------------------- V4 literals
# The metadata of the derived survey (codebook, labels,
# sub-population code lists, code policy).  They describe the views above.

CODEBOOK_ROWS = [
    # var, pos, code, label   (last pos of a var = its refusal label)
    ("PRIORITY", 1, 1.0, "1-URGENT"),
    ("PRIORITY", 2, 2.0, "2-HIGH"),
    ("PRIORITY", 3, 3.0, "3-MEDIUM"),
    ("PRIORITY", 4, 5.0, "5-LOW"),
    ("PRIORITY", 5, 4.0, "4-NOT SPECIFIED"),
    ("STATUS", 1, 1.0, "Fulfilled"),
    ("STATUS", 2, 2.0, "Open"),
    ("STATUS", 3, 3.0, "Pending"),
]

VARIABLE_ROWS = [
    ("PRIORITY", "Q1. How urgent was your order? "),
    ("STATUS", "What is the status of your order"),
]

GROUP_CODE_ROWS = [
    # attribute, grp, code
    ("SEGMENT", "AUTOMOBILE", "AUTOMOBILE"),
    ("SEGMENT", "BUILDING", "BUILDING"),
    ("SEGMENT", "FURNITURE", "FURNITURE"),
    ("SEGMENT", "HOUSEHOLD", "HOUSEHOLD"),
    ("SEGMENT", "MACHINERY", "MACHINERY"),
    ("REGION", "AFRICA", "AFRICA"),
    ("REGION", "AMERICA", "AMERICA"),
    ("REGION", "ASIA", "ASIA"),
    ("REGION", "EUROPE", "EUROPE"),
    ("REGION", "MIDDLE EAST", "MIDDLE EAST"),
    ("BALANCE", "negative", "-1"),
    ("BALANCE", "low", "0"), ("BALANCE", "low", "1"), ("BALANCE", "low", "2"),
    ("BALANCE", "middle", "3"), ("BALANCE", "middle", "4"), ("BALANCE", "middle", "5"),
    ("BALANCE", "high", "6"), ("BALANCE", "high", "7"), ("BALANCE", "high", "8"),
    ("BALANCE", "high", "9"),
]

GLOBAL_INVALID = [-8.0, -7.0, -5.0, -4.0, -1.0, 0.0]
GLOBAL_REFUSAL = [-3.0, 98.0, 99.0]

QUESTION_POLICY_ROWS = [
    # var, invalid_codes, refusal_codes (None = global), question_text, split
    ("PRIORITY", [], [4.0], None, "train"),
    ("STATUS", [], None, "What is the status of your order?", "eval"),
]

# attribute columns of V1/V2 used for membership (attribute -> column)
ATTRIBUTE_COLUMNS = {"SEGMENT": "segment", "REGION": "region", "BALANCE": "balance_code"}


def codebook(spark: SparkSession) -> DataFrame:
    return literal_table(spark, CODEBOOK_ROWS, "var string, pos int, code double, label string")


def variables(spark: SparkSession) -> DataFrame:
    return literal_table(spark, VARIABLE_ROWS, "var string, label string")


def group_codes(spark: SparkSession) -> DataFrame:
    return literal_table(spark, GROUP_CODE_ROWS, "attribute string, grp string, code string")


def question_policy(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("var", T.StringType()),
        T.StructField("invalid_codes", T.ArrayType(T.DoubleType())),
        T.StructField("refusal_codes", T.ArrayType(T.DoubleType())),
        T.StructField("question_text", T.StringType()),
        T.StructField("split", T.StringType()),
    ])
    return literal_table(spark, QUESTION_POLICY_ROWS, schema)


# ---------------------------------------------------------------- V9

def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: one scored row per embedding vector.

    ``logits`` = the 64 floats as doubles (a vocabulary whose first 26
    entries are the letters A..Z); K = 5 + label options; ``gold`` = softmax
    of entries 33..32+K (a human distribution); ``ordinal`` = 1..K with the
    last option marked -1 ("no order") on every 4th row.
    """
    from quorum.functions.metrics import softmax
    e = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    k = F.col("label") + 5
    gold = softmax(F.slice(x, 33, k))
    ordinal = F.transform(F.sequence(F.lit(1), k), lambda i: F.when(
        (F.col("vec_id") % 4 == 0) & (i == k), F.lit(-1.0)).otherwise(i.cast("double")))
    return e.select(F.col("vec_id").alias("row_idx"), "label", k.alias("k"),
                    x.alias("logits"), gold.alias("gold"), ordinal.alias("ordinal"))


# ---------------------------------------------------------------- steering metadata
# Steering texts and the steered groups of the derived survey.

STEERING_ROWS = [
    # attribute, bio_prompt, qa_prompt, portray_prompt, no_prompt, options
    ("SEGMENT",
     "Below you will be asked to describe the market segment you buy for. Description: I buy for the",
     "Which market segment do you buy for?",
     "Answer the following question as if you bought for the",
     "", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
    ("REGION",
     "Below you will be asked to describe where you live. Description: I live in",
     "Which region do you live in?",
     "Answer the following question as if you lived in",
     "", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]),
    ("BALANCE",
     "Below you will be asked to describe your account balance. Description: My balance is",
     "How large is your account balance?",
     "Answer the following question as if your balance were",
     "", ["negative", "low", "middle", "high"]),
]

DEMOGRAPHIC_ROWS = [
    # attribute, group list literal (as in a demographics CSV)
    ("SEGMENT", "['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']"),
    ("REGION", "['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST']"),
    ("BALANCE", "['negative', 'low', 'middle', 'high']"),
]


def steering(spark: SparkSession) -> DataFrame:
    return literal_table(spark, STEERING_ROWS, "attribute string, bio_prompt string, qa_prompt string, "
                                               "portray_prompt string, no_prompt string, options array<string>")


def demographics(spark: SparkSession) -> DataFrame:
    return literal_table(spark, DEMOGRAPHIC_ROWS, "attribute string, `group` string")
