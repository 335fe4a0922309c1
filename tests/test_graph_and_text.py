import random

from pyspark.sql import functions as F

from larkspur.operators import content as C
from larkspur.operators import graph as G
from larkspur.operators import measure as M
from larkspur.plans import queries as Q
from larkspur.streaming import windows as T


def graph(spark, n, edges):
    q = spark.createDataFrame([(f"q{i}", f"t{i}", float(100 - i), 0.0) for i in range(1, n + 1)], "id string, text_norm string, priority double, volume double")
    return q, spark.createDataFrame(edges, "a string, b string, serp_overlap int")


def groups(df):
    out = {}
    for x in df.collect():
        out.setdefault(x["cluster_id"], set()).add(x["id"])
    return [out[k] for k in sorted(out)]


def test_centroids_do_not_chain(spark):
    q, e = graph(spark, 3, [("q1", "q2", 5), ("q2", "q3", 5)])
    assert groups(G.centroid_clusters(q, e, 3)) == [{"q1", "q2"}, {"q3"}]


def test_thresholds_and_drift(spark):
    q, e = graph(spark, 5, [("q1", "q2", 6), ("q1", "q3", 3)])
    three, four = G.centroid_clusters(q, e, 3), G.centroid_clusters(q, e, 4)
    assert groups(three) == [{"q1", "q2", "q3"}, {"q4"}, {"q5"}]
    assert groups(four) == [{"q1", "q2"}, {"q3"}, {"q4"}, {"q5"}]
    assert {x["id"]: x["score"] for x in three.collect() if x["cluster_id"] == "c-001"} == {"q1": 1.0, "q2": 0.6, "q3": 0.3}
    s = G.drift_summary(three.select("id", "cluster_id"), four.select("id", "cluster_id")).first()
    assert (s["compared"], s["changed"], s["ratio"], s["split"], s["merged"]) == (5, 3, 0.6, 1, 0)


def test_clusters_equal_the_sequential_walk(spark):
    r = random.Random(4)
    n = 60
    pairs = {(f"q{min(a, b)}", f"q{max(a, b)}") for a, b in ((r.randint(1, n), r.randint(1, n)) for _ in range(150)) if a != b}
    edges = [(a, b, r.randint(1, 6)) for a, b in sorted(pairs)]
    q, e = graph(spark, n, edges)
    near = {}
    for a, b, o in edges:
        if o >= 3:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    head = {}
    for i in range(1, n + 1):
        x = f"q{i}"
        if x not in head:
            head[x] = x
            for y in near.get(x, ()):
                head.setdefault(y, x)
    assert {x["id"]: x["head_id"] for x in G.centroid_clusters(q, e, 3).collect()} == head


def test_depth_and_rank(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "y")], "src string, dst string")
    assert {x["node"]: x["depth"] for x in G.click_depth(links, "a").collect()} == {"a": 0, "b": 1, "c": 2, "d": 2}
    rank = {x["node"]: x["rank"] for x in G.page_rank(links, 30).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6 and rank["b"] > rank["x"]


def test_depth_and_rank_queries_go_to_the_end(spark, tmp_path):
    hops = [(i, j) for i in range(1, 7) for j in (i, i + 1)]  # p1 s1 p2 s2 ...: every supplier links on to the next part
    rows = [(i, i, 1, 1.0) for i in range(1, 7)] + [(j, i, 2, 30.0) for i, j in hops if i != j] + [(1, 9, 5, 1.0)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    depth = {x["node"]: x["depth"] for x in Q.QUERIES["click_depth"](spark, str(tmp_path)).collect()}
    assert depth == {f"p{i}": 2 * i - 2 for i in range(1, 8)} | {f"s{i}": 2 * i - 1 for i in range(1, 7)} | {"s9": 1}
    links = {(f"p{a}", f"s{b}") for a, b, *_ in rows} | {(f"s{b}", f"p{a}") for a, b, _, q in rows if q > 25}
    nodes = {x for e in links for x in e}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        out = {v: [b for a, b in links if a == v] for v in nodes}
        lost = sum(rank[v] for v in nodes if not out[v])
        rank = {v: (0.15 + 0.85 * lost) / len(nodes) + 0.85 * sum(rank[a] / len(out[a]) for a, b in links if b == v) for v in nodes}
    got = {x["node"]: x["rank"] for x in Q.QUERIES["page_rank"](spark, str(tmp_path)).collect()}
    assert got.keys() == nodes and all(abs(got[v] - rank[v]) < 6e-9 for v in nodes)  # the query rounds to eight digits


def test_ngram_overlap_and_short_texts(spark):
    words = " ".join("w" + c for c in "abcdefghijklmnopqrst")
    docs = spark.createDataFrame([(1, words), (2, "a b"), (3, None)], "doc_id long, text string")
    other = spark.createDataFrame([(7, words + " more"), (8, "a b")], "item_id long, text string")
    got = C.ngram_overlap(docs, other).collect()
    assert [(x["doc_id"], x["item_id"], x["shared"], x["overlap"]) for x in got] == [(1, 7, 13, 1.0)]


def test_list_runs_and_headings(spark):
    lines = spark.createDataFrame([(1, i, k) for i, k in enumerate(["item", "item", "blank", "item", "prose", "item"])], "doc_id long, pos int, kind string")
    assert C.list_runs(lines).first()["longest_run"] == 2
    heads = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 2, 4)], "doc_id long, pos int, level int")
    assert [x["pos"] for x in C.heading_skips(heads).collect()] == [1]


def test_paragraph_mode_takes_the_first_of_ties(spark):
    docs = spark.createDataFrame([(1, "A. B.\n\nC.\n\nD. E.\n\nF.")], "doc_id long, text string")
    assert C.paragraph_mode(docs).first()["mode"] == 2


def test_verdict(spark):
    rows = [("clean", "A-01", "BLOCK", "pass"), ("clean", "A-02", "BLOCK", "requires_agent"), ("bad", "A-01", "BLOCK", "fail"), ("fine", "A-01", "WARN", "fail"), ("warned", "A-01", "WARN", "fail"), ("warned", "A-02", "WARN", "fail")]
    got = {x["draft"]: x["verdict"] for x in C.verdict(spark.createDataFrame(rows, "draft string, rule_id string, severity string, status string")).collect()}
    assert got == {"clean": "REWORK", "bad": "BLOCK", "fine": "PASS", "warned": "REWORK"}


def test_lint_relations(spark):
    lines = spark.createDataFrame([("a.md", 1, "**WRT-01** must"), ("b.md", 1, "| WRT-01 | again"), ("b.md", 2, "see WRT-02 and WRT-01"), ("a.md", 2, "WRT-05..07 are")], "file string, line_no int, text string")
    d = C.rule_definitions(lines)
    assert sorted((x["file"], x["rule_id"]) for x in d.collect()) == [("a.md", "WRT-01"), ("b.md", "WRT-01")]
    assert [x["rule_id"] for x in C.duplicate_rules(d).collect()] == ["WRT-01"]
    assert {x["rule_id"] for x in C.undefined_rules(C.rule_mentions(lines), d).collect()} == {"WRT-02", "WRT-05"}


def test_answers_need_repeats(spark):
    rows = [("e", "api", 1, i, "Ours is fine", ["ours.example"], None) for i in range(2)] + [("f", "ui", 1, i, "x ours", [], None) for i in range(3)]
    got = {x["engine"]: x for x in M.answer_scores(spark.createDataFrame(rows, "engine string, grounding string, prompt_id int, repeat int, answer string, cited array<string>, error string"), "ours", "ours.example", []).collect()}
    assert got["e"]["refused"] and not got["f"]["refused"] and got["e"]["citation_rate"] == 1.0 and got["f"]["mention_rate"] == 1.0


def test_logs(spark):
    line = '1.2.3.4 - - [08/Jul/2026:10:00:00 +0000] "GET /a HTTP/1.1" 404 12 "-" "Mozilla GPTBot/1.0"'
    got = M.bot_stats(M.read_logs(spark.createDataFrame([(line,), (line.replace("404", "200"),), ("junk",)], "value string"), ["GPTBot"])).first()
    assert (got["bot"], got["fetches"], got["share_404"], got["unique_urls"]) == ("GPTBot", 2, 0.5, 1)


def test_stream_equals_batch(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    rows = spark.range(500).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.repartition(5).write.parquet(path)
    stream = T.hourly(T.stream_of(spark, path, rows.schema, 1))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("hours").collect()) == sorted(T.hourly(rows).collect())
