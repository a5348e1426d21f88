"""Queries over prompt texts and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelweave.functions import text as T
from reelweave.operators import lists, tags
from reelweave.plans._query import query, table

def _clean_sql() -> str:
    steps, k = ["s0 AS (SELECT doc_id, lang, text AS t FROM documents)"], 0
    for _ in range(2):
        mark = r"regexp_replace(regexp_replace(t, '(\d)\.', '\1' || chr(1), 'g'), '\.(\d)', chr(1) || '\1', 'g')"
        t = f"replace(replace({mark}, '.', '. '), chr(1), '.')"
        t = f"replace(replace(replace(replace({t}, ',', ', '), chr(10), '. '), chr(13), ''), chr(9), ', ')"
        steps.append(f"s{k + 1} AS (SELECT doc_id, lang, {t} AS t FROM s{k})")
        k += 1
        for _ in range(3):
            t = "t"
            for pattern, new in T.CLEANING_RULES:
                t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
            words = rf"list_filter(string_split_regex(regexp_replace({t}, '[\s\x1c-\x1f\x85\pZ]+', ' ', 'g'), ' '), lambda w: w <> '')"
            steps.append(f"s{k + 1} AS (SELECT doc_id, lang, {words} AS l FROM s{k})")
            steps.append(f"s{k + 2} AS (SELECT doc_id, lang, array_to_string(list_filter(l, lambda w, i: i = 1 OR w <> l[i - 1]), ' ') AS t FROM s{k + 1})")
            k += 2
    return f"WITH {', '.join(steps)} SELECT lang, count(*) AS n_docs, CAST(sum(length(t)) AS BIGINT) AS n_chars, CAST(sum(length(t) - length(replace(t, ' ', '')) + 1) AS BIGINT) AS n_words, CAST(sum(CAST('0x' || substr(md5(doc_id || ':' || t), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS digest FROM s{k} GROUP BY lang"


@query(_clean_sql())
def clean_text_docs(spark, d):
    """Cleaned documents by language: counts, and the sum of their texts' digests."""
    t = table(spark, d, "documents").select("doc_id", "lang", T.clean_text(F.col("text")).alias("t"))
    words = F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "t")), 1, 15), 16, 10).cast("decimal(20,0)")
    return t.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("t")).alias("n_chars"), F.sum(words).cast("long").alias("n_words"), F.sum(digest).cast("decimal(38,0)").alias("digest"))


@query(r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, p[i] AS prompt FROM (
  SELECT doc_id, CASE WHEN len(q) = 0 THEN [''] ELSE q END AS p FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS q FROM documents)),
  unnest(range(1, len(p) + 1)) AS r(i)""")
def prompt_batch_split(spark, d):
    """Documents split into stripped prompts at line feeds."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.batch_prompts(F.col("text"), "\\n")).alias("pos", "prompt"))


@query("""SELECT conv_id, string_agg('"' || CAST(CAST(least(round_even(turn * 24.0 / 16.0, 0), 9) AS BIGINT) AS VARCHAR) || '" :"' || coalesce(text, '') || '"', ',' || chr(10) ORDER BY turn) AS prompts
  FROM conversations GROUP BY conv_id""")
def batch_prompt_keys(spark, d):
    """Frame-keyed prompt lines of each conversation, a line for each turn's text."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["t"]), "\x1f")
    return turns.select("conv_id", T.batch_prompt(joined, "\x1f", 24, 16, 10).alias("prompts"))


def _sides(spark, d):
    c = table(spark, d, "conversations")
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    side = lambda role: c.where(F.col("role") == role).select(F.col("conv_id").alias("list_id"), (F.row_number().over(w) - 1).alias("pos"), F.col("text").alias("value"))
    return side("user"), side("assistant")


_SIDES = """u AS (SELECT conv_id AS list_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text AS value FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id AS list_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text AS value FROM conversations WHERE role = 'assistant'),
nu AS (SELECT list_id, count(*) AS n FROM u GROUP BY 1), na AS (SELECT list_id, count(*) AS n FROM a GROUP BY 1)"""


@query(f"WITH {_SIDES} SELECT coalesce(u.list_id, a.list_id) AS list_id, CAST(coalesce(u.pos, a.pos) AS INTEGER) AS pos, concat_ws(' / ', u.value, a.value) AS value FROM u FULL JOIN a ON u.list_id = a.list_id AND u.pos = a.pos")
def merge_turns_zip_longest(spark, d):
    """User and assistant turns merged by position."""
    return lists.merge_lists(*_sides(spark, d), " / ")


@query(f"""WITH {_SIDES} SELECT nu.list_id, CAST(g.pos AS INTEGER) AS pos, u.value AS a, a.value AS b FROM nu JOIN na USING (list_id), unnest(range(greatest(nu.n, na.n))) AS g(pos)
  JOIN u ON u.list_id = nu.list_id AND u.pos = least(g.pos, nu.n - 1) JOIN a ON a.list_id = nu.list_id AND a.pos = least(g.pos, na.n - 1)""")
def zip_repeat_last(spark, d):
    """User and assistant turns, the shorter side's last turn repeated."""
    return _paired(lists.zip_repeat_last(*_sides(spark, d)))


def _paired(df):
    return df.select("list_id", F.col("pos").cast("int").alias("pos"), "a", "b")


@query(f"WITH {_SIDES} SELECT u.list_id, CAST(u.pos AS INTEGER) AS pos, u.value AS a, a.value AS b FROM u JOIN na USING (list_id) JOIN a ON a.list_id = u.list_id AND a.pos = u.pos % na.n")
def zip_modulo(spark, d):
    """User turns with assistant turns used cyclically."""
    return _paired(lists.zip_modulo(*_sides(spark, d)))


@query(f"WITH {_SIDES}, s AS (SELECT list_id FROM nu JOIN na USING (list_id) WHERE nu.n = na.n) SELECT u.list_id, CAST(u.pos AS INTEGER) AS pos, u.value AS a, a.value AS b FROM u JOIN s USING (list_id) JOIN a ON a.list_id = u.list_id AND a.pos = u.pos")
def zip_strict(spark, d):
    """Turns of conversations with as many user as assistant turns."""
    u, a = _sides(spark, d)
    same = lists.counts(u, "n").join(lists.counts(a, "m"), "list_id").where("n = m").select("list_id")
    return _paired(lists.zip_strict(u.join(same, "list_id"), a.join(same, "list_id")))


@query(f"WITH {_SIDES} SELECT u.list_id, CAST(u.pos AS INTEGER) AS pos, u.value AS a, a.value AS b FROM u JOIN a ON a.list_id = u.list_id AND a.pos = 0")
def broadcast_ref(spark, d):
    """Every user turn with the first assistant turn of its conversation as the one reference."""
    u, a = _sides(spark, d)
    ref = lists.pick(a, 0)
    return _paired(lists.broadcast_one_or_all(u.join(ref.select("list_id"), "list_id"), ref))


@query("""WITH k AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'both' END AS side FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
  UNION ALL SELECT DISTINCT l.doc_id, 'right' FROM labels l LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NULL) SELECT side, count(*) AS n FROM k GROUP BY side""")
def key_set_compare(spark, d):
    """How the ids of documents and of labels overlap."""
    return lists.compare_keys(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").groupBy("side").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT lang, CASE WHEN regexp_matches(lower(text), 'woman|women|female|lady') THEN 'woman' WHEN regexp_matches(lower(text), 'man|men|male|guy|bloke|dude') THEN 'man' END AS kind FROM documents),
n AS (SELECT lang, count(*) FILTER (WHERE kind = 'woman') AS women, count(*) FILTER (WHERE kind = 'man') AS men FROM k GROUP BY lang)
SELECT lang, women, men, concat_ws(' ', CASE WHEN women > 0 THEN 'There are ' || women || ' women in the video.' END, CASE WHEN men > 0 THEN 'There are ' || men || ' men in the video.' END) AS said,
 concat_ws(', ', CASE WHEN women = 0 THEN 'woman. women, female, lady' END, CASE WHEN men = 0 THEN 'man, men, male, guy, bloke, dude, beard, mustache' END) AS absent FROM n""")
def count_characters_by_lang(spark, d):
    """People that the texts of a language mention, as sentences."""
    kind = table(spark, d, "documents").select("lang", T.person_kind(F.col("text")).alias("kind"))
    n = kind.groupBy("lang").agg(F.count_if(F.col("kind") == "woman").alias("women"), F.count_if(F.col("kind") == "man").alias("men"))
    said, absent = T.people_sentences(F.col("women"), F.col("men"))
    return n.withColumns({"said": said, "absent": absent})


_TAGS = "SELECT l_orderkey, string_agg('(' || l_returnflag || l_linenumber % 3 || ':' || CASE WHEN l_discount < 0.02 THEN '-0.5' ELSE CAST(l_discount * 10 AS DECIMAL(6,2)) END || ')', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY 1"


def _tag_texts(spark, d):
    li = table(spark, d, "lineitem")
    score = F.when(F.col("l_discount") < 0.02, "-0.5").otherwise((F.col("l_discount") * 10).cast("decimal(6,2)").cast("string"))
    tag = F.concat(F.lit("("), "l_returnflag", (F.col("l_linenumber") % 3).cast("string"), F.lit(":"), score, F.lit(")"))
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", tag.alias("t"))))
    return li.groupBy("l_orderkey").agg(items.alias("l")).select("l_orderkey", F.array_join(F.transform("l", lambda x: x["t"]), ",").alias("text"))


@query(rf"""WITH t AS ({_TAGS}), m AS (SELECT l_orderkey, regexp_extract_all(text, '\(([^:]+):([-+]?\d*\.\d+|\d+)\)', 1) AS tags, regexp_extract_all(text, '\(([^:]+):([-+]?\d*\.\d+|\d+)\)', 2) AS scores FROM t),
x AS (SELECT l_orderkey, i AS pos, tags[i] AS tag, CAST(scores[i] AS DOUBLE) AS score FROM m, unnest(range(1, len(tags) + 1)) AS r(i)),
b AS (SELECT l_orderkey, tag, max(score) AS score, min(pos) AS first FROM x WHERE score > 0 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, first) AS INTEGER) AS rank FROM b) SELECT l_orderkey, rank, tag, score FROM r WHERE score > 0.7 OR rank <= 2""")
def fix_tags_topk(spark, d):
    """Tags of each order over a cutoff, the best two at least."""
    return tags.top_tags(_tag_texts(spark, d), "l_orderkey", "text", 0.7, 2)


@query(f"WITH t AS ({_TAGS}), m AS (SELECT l_orderkey, len(regexp_extract_all(text, ':-')) AS n FROM t) SELECT l_orderkey, n FROM m WHERE n > 0")
def negative_tags(spark, d):
    """How many tags of each order score 0 or less."""
    return tags.negative_tags(_tag_texts(spark, d), "l_orderkey", "text").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN turn >= 1 THEN replace(text, 'th', 'TH') ELSE text END AS value FROM conversations")
def replace_text_from_index(spark, d):
    """A literal replaced from the second turn on."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.replace_text(F.col("text"), F.col("turn"), "th", "TH", 1).alias("value"))


@query("SELECT conv_id, turn, CASE WHEN turn BETWEEN 1 AND 2 THEN text || ', best quality' ELSE text END AS value FROM conversations")
def add_text_range(spark, d):
    """A phrase appended to turns 1 and 2."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.add_text(F.col("text"), F.col("turn"), ", best quality", 1, 2).alias("value"))


@query("SELECT doc_id, concat_ws(' | ', nullif(lang, ''), nullif(source, ''), nullif(CASE WHEN n_chars > 1000 THEN 'long' ELSE '' END, '')) AS value FROM documents")
def merge_text(spark, d):
    """Non-empty columns joined."""
    size = F.when(F.col("n_chars") > 1000, "long").otherwise("")
    return table(spark, d, "documents").select("doc_id", T.merge_text(" | ", F.col("lang"), F.col("source"), size).alias("value"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part)
SELECT p_partkey, array_to_string(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: coalesce(a[i], '') || CASE WHEN coalesce(a[i], '') <> '' AND coalesce(b[i], '') <> '' THEN '+' ELSE '' END || coalesce(b[i], '')), ' ') AS value FROM p""")
def merge_delimited(spark, d):
    """Part names and types merged word by word."""
    return table(spark, d, "part").select("p_partkey", T.merge_delimited(" ", F.col("p_name"), F.col("p_type"), "+").alias("value"))


@query("SELECT event_type, CAST(value > 50 AS BOOLEAN) AS big, count(*) AS n, count(*) FILTER (WHERE props NOT IN ('{}', '')) AS n_true FROM events GROUP BY 1, 2")
def to_boolean(spark, d):
    """Whether the events' property objects hold anything."""
    e = table(spark, d, "events").select("event_type", (F.col("value") > 50).alias("big"), T.to_boolean(F.col("props")).alias("t"))
    return e.groupBy("event_type", "big").agg(F.count("*").alias("n"), F.count_if("t").alias("n_true"))


@query("SELECT event_id, array_to_string(json_extract_string(props, '$.*'), ',') AS value FROM events")
def to_text_values(spark, d):
    """Values of the events' property objects, joined."""
    return table(spark, d, "events").select("event_id", F.array_join(T.json_values(F.col("props")), ",").alias("value"))


@query("SELECT event_id, CAST(i - 1 AS INTEGER) AS pos, v[i] AS value FROM (SELECT event_id, json_extract_string(props, '$.*') AS v FROM events), unnest(range(1, len(v) + 1)) AS r(i)")
def to_text_list(spark, d):
    """Values of the events' property objects, one row each."""
    return table(spark, d, "events").select("event_id", F.posexplode(T.json_values(F.col("props"))).alias("pos", "value"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_tax AS added, CASE WHEN l_discount = 0 THEN 0.0 ELSE round(l_quantity / l_discount, 6) END AS ratio,
 CAST(trunc(l_quantity * (l_discount - 0.05)) AS BIGINT) AS whole FROM lineitem""")
def math_ops(spark, d):
    """Sums, quotients that are 0 for a divisor of 0, and truncated products."""
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", T.math(q, F.col("l_tax"), "add")[0].alias("added"),
        F.round(T.math(q, F.col("l_discount"), "divide")[0], 6).alias("ratio"), T.math(q, F.col("l_discount") - 0.05, "multiply")[1].alias("whole"),
    )


_MAX = 18446744073709551615


@query(f"SELECT o_orderkey, CAST(i AS INTEGER) AS pos, CAST(least(CAST({_MAX} AS HUGEINT) - o_orderkey % 6 + i, CAST({_MAX} AS HUGEINT)) AS DECIMAL(20,0)) AS seed FROM orders, range(8) AS r(i) WHERE i < 5 + o_custkey % 4")
def seed_list_increment(spark, d):
    """Rising unsigned 64-bit seeds of each order, held at their bound; bounds in falling order."""
    top = F.lit(str(_MAX)).cast("decimal(20,0)")
    o = table(spark, d, "orders")
    return lists.seed_lists(o, top, top - F.col("o_orderkey") % 6, "increment", 5 + F.col("o_custkey") % 4).select("o_orderkey", "pos", "seed")


@query("SELECT c_custkey, CAST(i AS INTEGER) AS pos, CAST(greatest(5 + c_custkey % 9 - i, 5) AS DECIMAL(20,0)) AS seed FROM customer, range(40) AS r(i) WHERE i < 6 + c_nationkey")
def seed_list_decrement(spark, d):
    """Falling seeds of each customer, held at their bound."""
    return lists.seed_lists(table(spark, d, "customer"), F.lit(5), 5 + F.col("c_custkey") % 9, "decrement", 6 + F.col("c_nationkey")).select("c_custkey", "pos", "seed")


@query("SELECT o_orderkey, CAST(o_custkey + (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS DECIMAL(38,0)) AS seed FROM orders")
def sampler_seeds(spark, d):
    """Rising seeds of each customer's orders."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, d, "orders").select("o_orderkey", lists.step_seeds(pos, F.col("o_custkey"), "increment").alias("seed"))


@query("SELECT n_nationkey, n_name, CAST(i AS INTEGER) AS pos FROM nation, range(5) AS r(i)")
def repeat_as_list(spark, d):
    """Every nation's name as a list of five."""
    return lists.repeat(table(spark, d, "nation").select("n_nationkey", "n_name"), 5)


@query()
def seed_list_random(spark, d):
    """Random seeds of each customer, from a sequential generator that its key starts."""
    c = table(spark, d, "customer")
    return lists.seed_lists(c, F.lit(0), F.lit(str(_MAX)), "random", F.lit(4), F.col("c_custkey")).select("c_custkey", "pos", "seed")


@query()
def random_prompts(spark, d):
    """Prompts of each part, drawn from a template of its own words."""
    words = lambda c: F.concat(F.lit("["), F.replace(F.col(c), F.lit(" "), F.lit("|")), F.lit("]"))
    template = F.concat(F.lit("a "), words("p_name"), F.lit(", [] ["), "p_type", F.lit("], by ["), "p_brand", F.lit("| |no one] [open"))
    rows = table(spark, d, "part")
    return lists.joined_prompts(lists.prompt_lists(rows, template, 1 + F.col("p_size") % 5, F.col("p_partkey")).select("p_partkey", "pos", "prompt"), "p_partkey")


@query("""SELECT c_custkey, printf('#00%02x00', 255 - i) AS object, printf('#%02x8080', 255 - i) AS face,
 concat_ws(',', printf('#%02x8080', 255 - i), printf('#%02x0000', 255 - i), array_to_string(list_transform(range(10), lambda j: printf('#%02x%02x00', 255 - i, 255 - j)), ','),
  array_to_string(list_transform(range(10), lambda j: printf('#%02x00%02x', 255 - i, 255 - j)), ',')) AS colours FROM (SELECT c_custkey, CAST(c_custkey % 200 AS INTEGER) AS i FROM customer)""")
def character_mask_colors(spark, d):
    """Colour lists of characters: one for each customer."""
    i = (F.col("c_custkey") % 200).cast("int")
    return table(spark, d, "customer").select("c_custkey", T.character_colours("object", i).alias("object"), T.character_colours("face", i).alias("face"), T.character_colours("character", i).alias("colours"))


@query("""SELECT event_id, CAST(len(v) AS INTEGER) AS n, array_to_string(v, '|') AS value FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN json_extract_string(props, '$.*')
 WHEN 1 THEN [CAST(user_id AS VARCHAR), event_type, 'True', 'None'] WHEN 2 THEN [user_id || '.5'] WHEN 3 THEN [event_type] ELSE ['False'] END AS v FROM events)""")
def json_items_text(spark, d):
    """Objects, lists, numbers, literals and plain words as lists of texts."""
    user, kind = F.col("user_id").cast("string"), F.col("event_id") % 5
    listed = F.concat(F.lit("["), user, F.lit(', "'), F.col("event_type"), F.lit('", true, null]'))
    text = F.when(kind == 0, F.col("props")).when(kind == 1, listed).when(kind == 2, F.concat(user, F.lit(".5"))).when(kind == 3, F.col("event_type")).otherwise("false")
    items = table(spark, d, "events").select("event_id", T.json_items(text).alias("v"))
    return items.select("event_id", F.size("v").alias("n"), F.array_join("v", "|").alias("value"))
