"""Catalogue queries of what an application asks of its tables: guarded writes, reports, tools and state, on the rows of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import access, evaluation, retrieval, tools
from ..streaming import limits
from .catalog import query, t


@query("SELECT o_custkey AS repo_id, max_by(o_orderstatus || o_orderkey, (o_orderdate, o_orderkey % 2, o_orderstatus || o_orderkey)) AS details, max(o_orderdate) AS updated_at FROM orders GROUP BY o_custkey")
def latest_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of details for each key: odd orders are new rows, even ones are saved."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo_id"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("details"), F.col("o_orderdate").alias("updated_at"), (F.col("o_orderkey") % 2 == 1).alias("new"))
    return access.with_details(o.where("not new").drop("new"), o.where("new").drop("new"), ["repo_id"])


@query("""SELECT sha256(lower(c_name)) AS repo_id, c_name AS repo_full_name, 'http://h/' || c_custkey AS repo_url, (TIMESTAMP '2020-01-01 00:00:00' + to_days((c_custkey % 365)::INTEGER))::VARCHAR AS created
          FROM customer WHERE c_nationkey % 2 = 1""")
def new_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for repositories; those of even nations are known already."""
    c = t(spark, sf_dir, "customer")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")), "yyyy-MM-dd'T00:00:00Z'")
    rows = c.select(F.col("c_name").alias("repo_full_name"), F.concat(F.lit("http://h/"), F.col("c_custkey").cast("string")).alias("repo_url"), day.alias("repo_created_at"), "c_nationkey")
    found = access.new_repositories(rows.where("c_nationkey % 2 = 0"), rows.drop("c_nationkey"))
    return found.select("repo_id", "repo_full_name", "repo_url", F.date_format("repo_created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("SELECT vec_id, CASE WHEN label % 2 = 0 THEN label * 10 ELSE label END::INTEGER AS label FROM embeddings")
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of many rows replaced by key."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))
    return access.update_vectors(e, e.where("label % 2 = 0").select("vec_id", (F.col("label") * 10).alias("label")), "vec_id", "label")


@query("""WITH m AS (SELECT conv_id, turn, role, min(text) AS text FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) = 1 AS last FROM m)
          SELECT conv_id, turn, role, CASE WHEN last AND role = 'user' THEN 'edited' ELSE text END AS text FROM r""")
def edit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users ask to change all their messages; only one that is the last of its conversation is changed."""
    m = t(spark, sf_dir, "conversations").groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    asked = m.where("role = 'user'").withColumn("text", F.lit("edited"))
    return access.update_latest(m, asked, ["conv_id"], [F.desc("turn"), F.col("role")], ["conv_id", "turn", "role"], "text")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'New Chat' ELSE c_mktsegment END AS chat_name, c_mktsegment <> 'BUILDING' AS named_by_user
          FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) < 12""")
def new_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("  ").alias("chat_name"))
    return access.new_rooms(asked, t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 12).select("c_custkey", "chat_name", "named_by_user")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic = 0")
def flag_is_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents known not to be toxic; unlabelled ones are no such."""
    rows = t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("flag")), "doc_id", "left")
    return rows.where(access.is_false(F.col("flag"))).select("doc_id")


@query("""SELECT c_custkey, c_custkey % 3 <> 1 AS email, c_custkey % 2 = 0 AND length(c_custkey::VARCHAR) >= 1 AS password FROM customer""")
def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and passwords made of customers' numbers, some of them bad."""
    n = F.col("c_custkey").cast("string")
    email = F.concat(F.lit("a.b"), n, F.when(F.col("c_custkey") % 3 == 1, "@@x.org").otherwise("@mail-x.example.org"))
    password = F.concat(F.lit("Pass-word"), F.when(F.col("c_custkey") % 2 == 0, n).otherwise("x"))
    return t(spark, sf_dir, "customer").select("c_custkey", X.is_email(email).alias("email"), X.is_new_password(password).alias("password"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_custkey = 7 ")
def ordered_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of an owner in order, without a limit; the place shows the order."""
    rows = t(spark, sf_dir, "orders").where("o_custkey = 7").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return rows.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("place"))


@query("""SELECT p_partkey, '{"name":"' || p_name || '","size":' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',"type":"' || p_type || '"' END || '}' AS chunk, p_size AS size FROM part""")
def chunk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks to JSON and back; nulls are left out."""
    text = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("type")))
    return t(spark, sf_dir, "part").select("p_partkey", text.alias("chunk")).withColumn("size", F.from_json("chunk", "name string, size int, type string")["size"])


@query("""SELECT s_name AS repo_full_name, 'of ' || s_nationkey AS description, s_nationkey::VARCHAR AS created_at, n_name AS owner, d.details AS dep_details
          FROM supplier JOIN nation ON n_nationkey = s_nationkey, (SELECT coalesce(string_agg(p_name || p_partkey, ';' ORDER BY p_name || p_partkey), '') AS details FROM part WHERE p_size % 50 = 7) d WHERE s_suppkey = 7""")
def repo_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("owner"))
    n = F.col("s_nationkey").cast("string")
    repos = t(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").cast("string").alias("repo_id"), F.col("s_name").alias("repo_full_name"), F.concat(F.lit("of "), n).alias("description"), n.alias("created_at"), "owner")
    details = t(spark, sf_dir, "part").select((F.col("p_size") % 50).cast("string").alias("repo_id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("details"))
    found = tools.call({"get_repo_details": lambda repo_id: tools.repo_details(repos, details, repo_id)}, "get_repo_details", '{"repo_id": "7"}')
    return found.withColumn("dep_details", F.array_join("dep_details", ";"))


@query("SELECT p_name || p_partkey AS name, p_brand AS version, p_type AS type, 'f' || p_partkey // 12 AS file_path FROM part WHERE (p_name || p_partkey) ILIKE '%RE%'")
def dep_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").withColumn("file_id", F.expr("p_partkey div 12"))
    deps = p.select("file_id", F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("version"), F.col("p_type").alias("type"))
    files = p.select("file_id", F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("path")).distinct()
    return tools.call({"get_dep_version": lambda dep_name: tools.dependency_version(deps, files, dep_name)}, "get_dep_version", {"dep_name": "RE"})


_MODELS = ["view", "groq/click", "groq/purchase", "error"]


@query("""WITH b AS (SELECT user_id, bool_or(event_type = 'view' AND value > 50) AS v, bool_or(event_type = 'click' AND value > 50) AS c, bool_or(event_type = 'purchase' AND value > 50) AS p, bool_or(event_type = 'error' AND value > 50) AS e FROM events GROUP BY user_id)
          SELECT user_id, CASE WHEN NOT v THEN 'view' WHEN NOT c THEN 'groq/click' WHEN NOT p THEN 'groq/purchase' WHEN NOT e THEN 'error' END AS model,
                 CASE WHEN NOT c THEN 'groq/click' WHEN NOT p THEN 'groq/purchase' WHEN NOT e THEN 'error' END AS anonymous, CASE WHEN NOT p THEN 'groq/purchase' WHEN NOT c THEN 'groq/click' END AS title,
                 CASE WHEN NOT p THEN 'groq/purchase' WHEN NOT e THEN 'error' END AS after_two FROM b""")
def fallback_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next model for signed-in and anonymous users, for titles, and after two that failed."""
    name = F.when(F.col("event_type").isin("click", "purchase"), F.concat(F.lit("groq/"), "event_type")).otherwise(F.col("event_type"))
    broken = t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, name)).alias("models"))
    found = [limits.fallback_model(broken, _MODELS, ["user_id"], **how).withColumnRenamed("model", to) for to, how in (("model", {}), ("anonymous", {"anonymous": True}), ("title", {"title": True}), ("after_two", {"failed": 2}))]
    first, *rest = found
    for other in rest:
        first = first.join(other, "user_id")
    return first


@query("""WITH n AS (SELECT max(epoch_us(ts)) / 1e6 AS t FROM events), l AS (SELECT user_id, max_by(event_type, epoch_us(ts)) AS kind, max(epoch_us(ts)) / 1e6 AS started FROM (SELECT user_id, ts, min(event_type) AS event_type FROM events GROUP BY ALL) GROUP BY user_id)
          SELECT user_id, started FROM l, n WHERE kind = 'view' AND t - started <= 86400""")
def active_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last event is a view of the last day have an open stream."""
    e = t(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("event_type").alias("event_type"))
    e = e.select("user_id", F.when(F.col("event_type") == "view", "start").otherwise("end").alias("kind"), limits.seconds(F.col("ts")).alias("at"))
    now = e.agg(F.max("at")).first()[0]
    return limits.active_streams(e, "user_id", "at", F.lit(now), 86_400.0)


@query("""SELECT l_orderkey AS stream, (l_linenumber % 2)::INTEGER AS idx, string_agg(CASE WHEN l_linenumber <= 2 THEN 'c' || l_linenumber END, '' ORDER BY l_linenumber, l_partkey) AS id, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_partkey) AS name,
                 string_agg(l_partkey::VARCHAR, '' ORDER BY l_linenumber, l_partkey) AS arguments, max_by(l_linestatus, l_linenumber) AS signature FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_partkey) AS l_partkey, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) GROUP BY ALL""")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pieces of streamed calls, two calls to an order."""
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_partkey", "l_linestatus")])
    n = F.col("l_linenumber")
    deltas = lines.select(
        F.col("l_orderkey").alias("stream"), (n % 2).cast("int").alias("idx"), n.alias("place"), F.when(n <= 2, F.concat(F.lit("c"), n.cast("string"))).alias("id"), F.col("l_returnflag").alias("name"),
        F.col("l_partkey").cast("string").alias("arguments"), F.col("l_linestatus").alias("signature"),
    )
    found = limits.tool_calls(deltas, ["stream"], "place")
    return found.withColumn("id", F.nullif("id", F.lit("")))


@query("""SELECT lang, count(*) AS rows, count(*) FILTER (n_chars % 4 < 3) AS scored, round(avg(n_chars % 4) FILTER (n_chars % 4 < 3), 4) AS avg_correctness FROM documents GROUP BY lang""")
def judge_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores out of JSON reports; 3 and true are no scores."""
    n = F.col("n_chars") % 4
    report = F.format_string('{"correctness": {"score": %s, "reason": "x"}}', F.when(n == 3, F.when(F.col("doc_id") % 2 == 0, "3").otherwise("true")).otherwise(n.cast("string")))
    rows = evaluation.judge_scores(t(spark, sf_dir, "documents").select("lang", report.alias("evaluation")), ["correctness"])
    return evaluation.judge_averages(rows, ["correctness"], ["lang"])


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id, n) AS i FROM (SELECT doc_id, lang, source, n_chars % 3 AS n FROM documents)), w AS (SELECT lang, source, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)
          SELECT count(*) AS rows, count(*) AS scored, round(avg(s.n), 4) AS avg_n FROM s JOIN w ON s.lang = w.lang AND s.source = w.source AND i <= w.n""")
def recalculated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved report reduced to selected cases, each as often as it is named."""
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 3).cast("int").alias("n"))
    return evaluation.recalculated(d, d.where("doc_id % 3 = 0").select("lang", "source"), ["lang", "source"], ["n"])


@query("""SELECT l_partkey AS id, min_by(l_orderkey, (list_no, rank)) AS l_orderkey, min(list_no) AS list_no FROM (SELECT l_partkey, l_orderkey, 0 AS list_no, l_linenumber * 10000000 + l_orderkey AS rank FROM lineitem WHERE l_returnflag = 'A'
          UNION ALL SELECT l_partkey, l_orderkey, 1, l_linenumber * 10000000 + l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY l_partkey""")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each id from the first of two lists that holds it."""
    lines = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey", (F.col("l_linenumber") * 10_000_000 + F.col("l_orderkey")).alias("rank"), "l_returnflag")
    return retrieval.first_seen([lines.where(F.col("l_returnflag") == f).withColumn("list_no", F.lit(i)) for i, f in enumerate("AR")], "id", ["l_orderkey", "list_no"])


@query(r"""SELECT doc_id, 'x ![a](http://new/' || doc_id || ') y ![b](keep.png)' AS rewritten, len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]'))::INTEGER + 1 AS cost FROM documents""")
def rewrite_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New addresses for known images; the token cost of a text together with another and a null."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("x ![a](http://old/"), i, F.lit(") y ![b](keep.png)"))
    mapping = F.create_map(F.concat(F.lit("http://old/"), i), F.concat(F.lit("http://new/"), i))
    return t(spark, sf_dir, "documents").select("doc_id", X.replace_image_sources(text, mapping).alias("rewritten"), X.token_cost(F.array("text", F.lit("one"), F.lit(None).cast("string"))).alias("cost"))
