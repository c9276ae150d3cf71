"""Text, JSON, markup and reply-parsing queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.functions import text as tx
from pointgate.operators.joins import salted_join
from pointgate.operators.near import jaccard_pairs
from pointgate.plans.registry import query
from pointgate.session import cut, table

_TIER = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN " + ("NULL" if n == "excluded" else f"'{n}'") for n, p in tx.TIERS) + " ELSE 'unmatched' END"


@query("tier_classifier", f"SELECT doc_id, {_TIER} AS tier FROM documents WHERE text IS NOT NULL")
def tier_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tier whose pattern a report matches."""
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", tx.tier(F.col("text")).alias("tier"))


@query(
    "number_extract_match",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(\d+(?:\.\d+)?(?: percent)?)', 1) AS raw, n_chars FROM documents),
n AS (SELECT doc_id, list_transform(raw, lambda s: CASE WHEN s LIKE '%percent' THEN regexp_extract(s, '^(\d+(?:\.\d+)?)', 1)::DOUBLE / 100 ELSE regexp_extract(s, '^(\d+(?:\.\d+)?)', 1)::DOUBLE END) AS xs FROM d),
c AS (SELECT *, [3.0::DOUBLE, 12.5::DOUBLE, 28.0::DOUBLE, 0.4::DOUBLE] AS ctx FROM n)
SELECT doc_id, len(xs) AS numbers, round(list_max(xs), 4) AS largest, len(list_filter(xs, lambda x: len(list_filter(ctx, lambda k: abs(x - k) <= 0.01 OR abs(x - k) <= 0.02 * abs(k) OR abs(x / 100 - k) <= 0.01 OR abs(x / 100 - k) <= 0.02 * abs(k) OR abs(x * 100 - k) <= 0.01 OR abs(x * 100 - k) <= 0.02 * abs(k))) > 0)) AS cited, round(xs[-1], 4) AS last FROM c""",
)
def number_extract_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a text, and how many of them a context supports."""
    context = F.array(*map(F.lit, (3.0, 12.5, 28.0, 0.4)))
    d = table(spark, sf_dir, "documents").select("doc_id", tx.numbers(F.col("text")).alias("xs"))
    return d.select("doc_id", F.size("xs").cast("long").alias("numbers"), F.round(F.array_max("xs"), 4).alias("largest"), F.size(F.filter("xs", lambda x: tx.cited(x, context))).cast("long").alias("cited"), F.round(F.try_element_at("xs", F.lit(-1)), 4).alias("last"))


@query("all_terms_search", "SELECT doc_id, published_ms FROM documents WHERE contains(lower(concat_ws(' ', title, text, player_name)), 'hamstring') AND contains(lower(concat_ws(' ', title, text, player_name)), 'snaps') AND position = 'RB' ORDER BY published_ms DESC NULLS LAST, doc_id LIMIT 50")
def all_terms_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest documents of a position that hold all terms."""
    hay = F.lower(F.concat_ws(" ", "title", "text", "player_name"))
    d = table(spark, sf_dir, "documents").where((F.col("position") == "RB") & F.contains(hay, F.lit("hamstring")) & F.contains(hay, F.lit("snaps")))
    return d.orderBy(F.col("published_ms").desc_nulls_last(), "doc_id").limit(50).select("doc_id", "published_ms")


@query(
    "fingerprint_dedup",
    r"""WITH f AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))) AS fp FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[\x20-\x7e]*$')), i AS (SELECT sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))) AS fp FROM eval_items)
SELECT min(doc_id) AS doc_id, fp, count(*) AS copies FROM f WHERE fp NOT IN (SELECT fp FROM i) GROUP BY fp""",
)
def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of equal plain-ASCII texts, the lowest id; texts of evaluation items are left out."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & F.col("text").rlike(r"^[\x20-\x7e]*\z")).select("doc_id", tx.fingerprint(F.col("text")).alias("fp"))
    items = table(spark, sf_dir, "eval_items").select(tx.fingerprint(F.col("text")).alias("fp"))
    return d.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).join(items, "fp", "left_anti").select("doc_id", "fp", "copies")


@query("fingerprint_dedup_all")
def fingerprint_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fingerprint_dedup`` over every text that is not null, in any script, with tabs and line breaks."""
    mark = tx.fingerprint(F.col("text"), tx.SPACE).alias("fp")
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", mark)
    items = table(spark, sf_dir, "eval_items").select(mark)
    return d.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).join(items, "fp", "left_anti").select("doc_id", "fp", "copies")


@query("simhash_neardup")
def simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class, other, distance): classes of equal texts whose SimHash differs in at most one bit and whose length by 1 %.

    Equal texts are one class with its lowest document.  Two hashes that differ in one bit agree
    in one of their two halves, so an equi-join on the halves finds every pair.
    """
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & (F.length("text") > 0)).groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    w = d.select("doc_id", F.length("text").alias("n"), F.posexplode(tx.words(F.col("text"))).alias("i", "w"))
    next_ = lambda k: F.lead("w", k).over(Window.partitionBy("doc_id").orderBy("i"))
    grams = w.select("doc_id", "n", "i", F.xxhash64("w", *map(next_, range(1, 5))).alias("g"), next_(4).alias("_whole")).where(F.col("_whole").isNotNull() | (F.col("i") == 0))
    h = tx.simhash(grams.select("doc_id", "n", "g").distinct(), ["doc_id", "n"], "g")
    low, high = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)), F.call_function("shiftrightunsigned", F.col("h"), F.lit(32))
    k = h.select("doc_id", "n", "h", F.explode(F.array(F.struct(F.lit(0).alias("half"), low.alias("v")), F.struct(F.lit(1).alias("half"), high.alias("v")))).alias("b")).select("doc_id", "n", "h", "b.half", "b.v")
    a, b = k.toDF("class", "n_a", "h_a", "half", "v"), k.toDF("other", "n_b", "h_b", "half", "v")
    distance = F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b")))
    near = (F.abs(F.col("n_a") - F.col("n_b")) <= 0.01 * F.greatest("n_a", "n_b")) & (distance <= 1)
    return a.join(b, ["half", "v"]).where((F.col("class") < F.col("other")) & near).select("class", "other", distance.cast("int").alias("distance")).distinct()


@query("jaccard_neardup")
def jaccard_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class, other, jaccard): classes of equal texts that share at least 0.8 of their 5-word shingles, all of them.

    Equal texts are one class with its lowest document; texts without words have no shingles.
    """
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.unhex(F.sha2("text", 256)).alias("class"), "doc_id", "text")
    g = d.select("class", tx.hashed_shingles(tx.words(F.col("text")), 5).alias("g"))
    pairs = cut(jaccard_pairs(g, id="class", items="g"))
    first = d.groupBy("class").agg(F.min("doc_id").alias("first")).dropna()
    x = pairs.join(first.toDF("a", "_a"), "a").join(first.toDF("b", "_b"), "b")
    return x.select(F.least("_a", "_b").alias("class"), F.greatest("_a", "_b").alias("other"), F.round("jaccard", 6).alias("jaccard"))


@query("text_classes", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL AND text <> ''")
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in the classes of equal texts, named by their lowest document."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    c = d.groupBy("h").agg(F.min("doc_id").alias("class"), F.count("*").alias("copies"))
    return salted_join(d, c, ["h"], ["doc_id"]).select("doc_id", "class", "copies")


@query(
    "chat_assembly",
    """WITH m AS (SELECT row_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM t11_targeted_v1)
SELECT row_id, string_agg('<' || m.role || '>' || m.content, chr(10) ORDER BY i) AS prompt, count(*) AS turns, sum(length(m.content))::BIGINT AS chars FROM m GROUP BY 1""",
)
def chat_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of a row as one prompt."""
    one = F.transform("messages", lambda m: F.concat(F.lit("<"), m["role"], F.lit(">"), m["content"]))
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.length(m["content"]))
    return table(spark, sf_dir, "t11_targeted_v1").where(F.size("messages") > 0).select("row_id", F.array_join(one, "\n").alias("prompt"), F.size("messages").cast("long").alias("turns"), chars.alias("chars"))


def said(role: str) -> Column:
    return F.element_at(F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"]), 1)


_SAID = "list_filter(messages, lambda m: m.role = '{0}')[1].content"


@query(
    "reply_parse",
    rf"""WITH a AS (SELECT row_id, {_SAID.format('assistant')} AS a FROM t11_targeted_v1)
SELECT row_id, CASE WHEN a LIKE '{{%' THEN CASE WHEN json_extract_string(TRY_CAST(a AS JSON), '$.pick') IS NOT NULL THEN 'pick' WHEN json_extract_string(TRY_CAST(a AS JSON), '$.tool') IS NOT NULL THEN 'tool' ELSE 'other' END WHEN regexp_matches(a, 'FINAL PROBABILITY') THEN 'probability' ELSE 'other' END AS kind,
  json_extract_string(TRY_CAST(CASE WHEN a LIKE '{{%' THEN a END AS JSON), '$.pick') AS pick, least(greatest(TRY_CAST(nullif(regexp_extract(a, 'FINAL PROBABILITY:? *([0-9.]+[0-9])', 1), '') AS DOUBLE), 0.01), 0.99) AS p FROM a""",
)
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reply does: a pick, a tool call, a probability (clipped), or something else."""
    a = table(spark, sf_dir, "t11_targeted_v1").select("row_id", said("assistant").alias("a"))
    pick, tool = F.get_json_object("a", "$.pick"), F.get_json_object("a", "$.tool")
    is_json = F.startswith("a", F.lit("{"))
    p = F.nullif(F.regexp_extract("a", r"FINAL PROBABILITY:? *([0-9.]+[0-9])", 1), F.lit("")).try_cast("double")
    kind = F.when(is_json, F.when(pick.isNotNull(), "pick").when(tool.isNotNull(), "tool").otherwise("other")).when(F.col("a").rlike("FINAL PROBABILITY"), "probability").otherwise("other")
    return a.select("row_id", kind.alias("kind"), F.when(is_json, pick).alias("pick"), F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99)).alias("p"))


@query(
    "observation_parse",
    rf"""WITH a AS (SELECT row_id, {_SAID.format('user')} AS u FROM t11_targeted_v1 WHERE bench = 'draftgym'),
b AS (SELECT row_id, TRY_CAST(nullif(regexp_extract(u, '(20[0-9][0-9]) board', 1), '') AS INTEGER) AS season, TRY_CAST(nullif(regexp_extract(u, 'pick ([0-9]+)', 1), '') AS INTEGER) AS pick_number, regexp_extract_all(u, '(P[0-9]{{3}}) (?:QB|RB|WR|TE) [0-9.]+ [0-9.]+ [0-9.]+', 1) AS visible FROM a)
SELECT row_id, season, pick_number, len(visible) AS visible, visible[1] AS first_visible FROM b""",
)
def observation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation inside a user message: season, pick and the players on the board."""
    u = table(spark, sf_dir, "t11_targeted_v1").where("bench = 'draftgym'").select("row_id", said("user").alias("u"))
    whole = lambda p: F.nullif(F.regexp_extract("u", p, 1), F.lit("")).try_cast("int")
    visible = F.regexp_extract_all("u", F.lit(r"(P[0-9]{3}) (?:QB|RB|WR|TE) [0-9.]+ [0-9.]+ [0-9.]+"), F.lit(1))
    return u.select("row_id", whole("(20[0-9][0-9]) board").alias("season"), whole("pick ([0-9]+)").alias("pick_number"), F.size(visible).cast("long").alias("visible"), F.try_element_at(visible, F.lit(1)).alias("first_visible"))


@query("json_props", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') IS NULL AS none_missing FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.from_json("props", "k int, none string")
    return table(spark, sf_dir, "events").select("event_id", x["k"].alias("k"), x["none"].isNull().alias("none_missing"))


@query(
    "answers_ingest",
    """WITH raw AS (SELECT o_orderkey, o_custkey AS question_id, CASE WHEN o_orderkey % 53 = 0 THEN 1.5 WHEN o_orderkey % 59 = 0 THEN NULL ELSE (o_orderkey % 100) / 100.0 END AS p FROM orders),
k AS (SELECT c_custkey AS question_id, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS outcome FROM customer WHERE c_custkey % 7 <> 0), r AS (SELECT raw.*, k.outcome, row_number() OVER (PARTITION BY raw.question_id ORDER BY o_orderkey) AS seq FROM raw LEFT JOIN k ON k.question_id = raw.question_id)
SELECT question_id % 10 AS batch, count(*) AS answers, count_if(outcome IS NULL) AS unknown, count_if(outcome IS NOT NULL AND (p IS NULL OR p > 1)) AS out_of_range, count_if(outcome IS NOT NULL AND seq > 1) AS duplicates,
  round(avg(CASE WHEN outcome IS NOT NULL AND seq = 1 AND p <= 1 THEN (p - outcome) * (p - outcome) END), 6) AS brier FROM r GROUP BY 1""",
)
def answers_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers against a key: the first counts; unknown, out-of-range and repeated ones are counted."""
    o = F.col("o_orderkey")
    p = F.when(o % 53 == 0, 1.5).when(o % 59 == 0, F.lit(None)).otherwise((o % 100) / 100.0)
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("question_id"), p.alias("p"))
    key = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("question_id"), (F.col("c_acctbal") > 0).cast("int").alias("outcome"))
    r = raw.join(key, "question_id", "left").withColumn("seq", F.row_number().over(Window.partitionBy("question_id").orderBy("o_orderkey")))
    known = F.col("outcome").isNotNull()
    good = known & (F.col("seq") == 1) & (F.col("p") <= 1)
    return r.groupBy((F.col("question_id") % 10).alias("batch")).agg(
        F.count("*").alias("answers"), F.count_if(~known).alias("unknown"), F.count_if(known & (F.col("p").isNull() | (F.col("p") > 1))).alias("out_of_range"), F.count_if(known & (F.col("seq") > 1)).alias("duplicates"),
        F.round(F.avg(F.when(good, (F.col("p") - F.col("outcome")) ** 2)), 6).alias("brier"),
    )


@query(
    "xml_and_html_parse",
    """SELECT doc_id, source_key AS guid, lang AS language, coalesce(n_chars, 0) AS size, CAST(3 AS BIGINT) AS cells FROM documents WHERE source_key IS NOT NULL AND regexp_matches(source_key, '^[A-Za-z0-9:_.-]+$')""",
)
def xml_and_html_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as XML with an HTML table inside, parsed back by ``from_xml`` and regular expressions."""
    d = table(spark, sf_dir, "documents").where(F.col("source_key").rlike(r"^[A-Za-z0-9:_.-]+\z"))
    html = F.concat(F.lit("&lt;td&gt;"), F.col("doc_id"), F.lit("&lt;/td&gt;&lt;td&gt;"), F.coalesce("lang", F.lit("")), F.lit("&lt;/td&gt;&lt;td&gt;"), F.coalesce("n_chars", F.lit(0)), F.lit("&lt;/td&gt;"))
    xml = F.concat(F.lit("<item><guid>"), F.col("source_key"), F.lit("</guid><description>"), html, F.lit("</description></item>"))
    x = d.select(F.from_xml(xml, F.lit("guid string, description string")).alias("x")).select("x.*")
    td = F.regexp_extract_all("description", F.lit("<td>([^<]*)</td>"), F.lit(1))
    return x.select(F.element_at(td, 1).cast("long").alias("doc_id"), "guid", F.nullif(F.element_at(td, 2), F.lit("")).alias("language"), F.element_at(td, 3).cast("long").alias("size"), F.size(td).cast("long").alias("cells"))


@query(
    "prompt_battery",
    """WITH g AS (SELECT DISTINCT season, family FROM eval_items), b AS (SELECT p_brand, round(avg(p_retailprice), 2) AS rate, count(*) AS n FROM part GROUP BY 1)
SELECT season, family, p_brand, 'Season ' || season || ', family ' || family || ': anchor ' || CAST(n AS VARCHAR) || ' parts.' AS prompt, sha256(lower('Season ' || season || ', family ' || family || ': anchor ' || CAST(n AS VARCHAR) || ' parts.')) AS prompt_hash FROM g, b WHERE n >= 20""",
)
def prompt_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for every cell of the grid, with its fingerprint; both sides of the grid are small vocabularies."""
    g = table(spark, sf_dir, "eval_items").select("season", "family").distinct()
    b = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).where("n >= 20")
    prompt = F.concat(F.lit("Season "), F.col("season"), F.lit(", family "), F.col("family"), F.lit(": anchor "), F.col("n"), F.lit(" parts."))
    return g.crossJoin(b).select("season", "family", "p_brand", prompt.alias("prompt"), F.sha2(F.lower(prompt), 256).alias("prompt_hash"))


@query(
    "redact",
    r"SELECT item_id, regexp_replace(text, '[0-9]+(\.[0-9]+)?', '<num>', 'g') AS masked, len(regexp_extract_all(text, '[0-9]+(\.[0-9]+)?')) AS hidden FROM eval_items",
)
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))).cast("long")
    return table(spark, sf_dir, "eval_items").select("item_id", F.regexp_replace("text", r"[0-9]+(\.[0-9]+)?", "<num>").alias("masked"), n.alias("hidden"))


@query(
    "wikitext_parse",
    """SELECT DISTINCT player_id, position AS pos, player AS opener, 2 AS names FROM season_points WHERE player NOT LIKE '%|%'""",
)
def wikitext_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infobox lines with a staff list: fields by pattern, the names in order, the opener first."""
    s = table(spark, sf_dir, "season_points").where(~F.contains("player", F.lit("|"))).select("player_id", "position", "player").distinct()
    page = F.concat(F.lit("{{Infobox\n| id = "), "player_id", F.lit("\n| pos = "), "position", F.lit("\n| staff = [["), "player", F.lit("]] • [[Assistant "), "position", F.lit("]]\n}}"))
    field = lambda n: F.regexp_extract("page", rf"\| {n} = ([^\n]*)", 1)
    names = F.regexp_extract_all(field("staff"), F.lit(r"\[\[([^\]|]+)\]\]"), F.lit(1))
    return s.select(page.alias("page")).select(field("id").alias("player_id"), field("pos").alias("pos"), F.element_at(names, 1).alias("opener"), F.size(names).alias("names"))
