import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from larkspur.functions import scores, text
from larkspur.operators import observations as O
from larkspur.sources import observations as S
from larkspur.sources import pages, sinks
from larkspur.thresholds import Thresholds, flatten

NOW, PRIOR = O.windows(dt.date(2026, 8, 7))


def rows(spark, data):
    return spark.createDataFrame(data, "date date, query string, page string, clicks long, impressions long, position double")


def test_windows():
    assert NOW == (dt.date(2026, 7, 7), dt.date(2026, 8, 3))
    assert PRIOR == (dt.date(2026, 6, 9), dt.date(2026, 7, 6))


def test_window_entirely_provisional():
    with pytest.raises(ValueError):
        O.effective_window(dt.date(2026, 8, 5), dt.date(2026, 8, 7), dt.date(2026, 8, 7))


def test_striking_score(spark):
    out = O.striking(rows(spark, [(NOW[0], "q", "/p", 2, 500, 6.0), (NOW[0], "q2", "/p", 2, 19, 6.0), (NOW[0], "q3", "/p", 0, 500, 4.0)]), Thresholds()).collect()
    assert len(out) == 1 and out[0]["query"] == "q"
    assert out[0]["opportunity_score"] == pytest.approx(12.5)


def test_weighted_position_and_ctr(spark):
    out = O.aggregate(rows(spark, [(NOW[0], "q", "/p", 10, 1, 100.0), (NOW[0], "q", "/p", 0, 999, 1.0), (NOW[0], "q", "/p", 0, 500, None)]), "query").first()
    assert out["position"] == pytest.approx((100 + 999) / 1000)
    assert out["ctr"] == pytest.approx(10 / 1500)


def test_decay_differenced(spark):
    flat = [(f"/a/p{i}", 50, 50) for i in range(3)]
    now = [(NOW[0], "q", "/a/x", 20, 100, 1.0)] + [(NOW[0], "q", p, c, 100, 1.0) for p, _, c in flat]
    before = [(PRIOR[0], "q", "/a/x", 100, 100, 1.0)] + [(PRIOR[0], "q", p, c, 100, 1.0) for p, c, _ in flat]
    assert [x["page"] for x in O.decay(rows(spark, now), rows(spark, before), Thresholds()).collect()] == ["/a/x"]
    fallen = [(d, q, p, c // 5 if p != "/a/x" else c, i, o) for d, q, p, c, i, o in now]
    assert O.decay(rows(spark, fallen), rows(spark, before), Thresholds()).count() == 0


def test_rising_without_prior_and_lost(spark):
    now = rows(spark, [(NOW[0], "new", "/n", 30, 100, 3.0)])
    before = rows(spark, [(PRIOR[0], "old", "/o", 5, 120, 3.0), (PRIOR[0], "few", "/o", 5, 40, 3.0)])
    up = O.rising(now, before, Thresholds()).filter("scope = 'query'").collect()
    assert [(x["subject"], x["clicks_prior"]) for x in up] == [("new", None)]
    assert [(x["query"], x["impressions_now"]) for x in O.lost(now, before, Thresholds()).collect()] == [("old", 0)]


def test_gap_tie_takes_first_page(spark):
    out = O.gaps(rows(spark, [(NOW[0], "q", "/b", 0, 20, 35.0), (NOW[0], "q", "/a", 0, 20, 35.0)]), Thresholds()).first()
    assert (out["best_position"], out["best_page"]) == (35.0, "/a")


def test_seasonality_needs_history(spark):
    out = O.seasonality(rows(spark, [(NOW[0], "q", "/p", 1, 10, 1.0)]), NOW, Thresholds()).collect()
    assert [x["status"] for x in out] == ["insufficient_history"]


def test_expected_ctr_beyond_table(spark):
    got = [x[0] for x in spark.createDataFrame([(0.4,), (2.5,), (3.5,), (12.0,), (40.0,), (None,)], "p double").select(scores.expected_ctr(F.col("p"))).collect()]
    assert got[0] == 0.264 and got[1] == 0.121 and got[2] == 0.048
    assert got[3] == pytest.approx(0.01 * 0.85**2) and got[4] == 0.003 and got[5] is None


def test_position_bases(spark):
    one = spark.createDataFrame([(400.0, None, 100)], "sum_position double, position double, impressions long")
    assert O.one_basis(one).first()["position_sum"] == 400.0
    mixed = one.union(spark.createDataFrame([(None, 3.0, 10)], one.schema))
    with pytest.raises(ValueError):
        O.one_basis(mixed)
    raw = spark.createDataFrame([("2026-07-08T14:00:00", None, "/p", 3, 100, 400.0), ("2026-07-08", "q", "/p", 3, 0, 1.0)], "date string, query string, url string, clicks long, impressions long, sum_position double")
    got = S.coerce(raw).collect()
    assert len(got) == 1 and got[0]["position"] == 5.0 and got[0]["query"] == "" and got[0]["is_anonymized"] and got[0]["hour"] == 14


def test_flip_rate(spark):
    days = [dt.date(2026, 7, 10 + i) for i in range(4)]
    data = [(d, "q", u, 1, 10, 1.0 if (i % 2 == 0) == (u == "/a") else 2.0) for i, d in enumerate(days) for u in ("/a", "/b")]
    data += [(d, "s", "/a", 1, 10, 1.0) for d in days] + [(days[0], "one", "/a", 1, 10, 1.0), (days[0], "  ", "/a", 1, 10, 1.0), (days[0], None, "/a", 1, 10, 1.0)]
    got = {x["query"]: (x["flip_rate"], x["flips"], x["days"]) for x in O.flip_rate(O.collapse(rows(spark, data))).collect()}
    assert got == {"q": (1.0, 3, 4), "s": (0.0, 0, 4), "one": (0.0, 0, 1)}


def test_duplicates_collapse(spark):
    d = dt.date(2026, 7, 10)
    got = O.collapse(rows(spark, [(d, "q", "/a", 5, 100, 2.0), (d, "q", "/a", 5, 100, 4.0)])).collect()
    assert [(x["clicks"], x["impressions"], x["position_sum"]) for x in got] == [(10, 200, 400.0)]


@pytest.mark.parametrize(("similarity", "dominance", "expected"), [(0.5, 0.9, "DIFFERENTIATE"), (0.97, 0.95, "REDIRECT_301"), (0.97, 0.57, "CONSOLIDATE"), (None, 0.9, None)])
def test_branches(spark, similarity, dominance, expected):
    one = spark.createDataFrame([(similarity, dominance)], "s double, d double")
    assert one.select(O.branch(F.col("s"), F.col("d"))).first()[0] == expected


def test_cosine_errors(spark):
    bad = spark.createDataFrame([([1.0, 0.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="dimensions"):
        bad.select(scores.cosine(F.col("a"), F.col("b"))).collect()
    with pytest.raises(Exception, match="zero"):
        spark.createDataFrame([([0.0], [1.0])], "a array<double>, b array<double>").select(scores.cosine(F.col("a"), F.col("b"))).collect()


def test_thresholds_record_their_source():
    t = Thresholds({"decay": {"drop": {"value": -0.5}}})
    assert t.get("decay.drop") == -0.5 and t.get("lost.drop") == -0.8 and t.get("nowhere", 3) == 3
    assert [u["source"] for u in t.used()] == ["local", "doctrine", "fallback"]
    with pytest.raises(KeyError):
        t.get("nowhere.else")
    assert flatten({"a": {"b": 1, "c": {"value": 2}}}) == {"a.b": 1, "a.c": 2}


def test_segment_gate():
    assert O.segmentation_gate([], Thresholds()) == "BLOCK"
    assert O.segmentation_gate([], Thresholds({"segmentation.require_brand_tokens": False})) == "INFO"
    assert O.segmentation_gate(["x"], Thresholds()) is None


def test_findings_are_ordered_whatever_the_input_order(spark):
    data = [(NOW[0], f"q{i}", "/p", 0, 50 + i, 30.0) for i in range(20)]
    one = O.ordered(O.findings({"gaps": O.gaps(rows(spark, data), Thresholds())})).collect()
    two = O.ordered(O.findings({"gaps": O.gaps(rows(spark, data[::-1]).repartition(3), Thresholds())})).collect()
    assert one == two and one[0]["id"] == "GAP-0001"


def test_csv_export(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("﻿Дата;Запит;Сторінка;Кліки;Покази;CTR;Позиція\n2026-07-08;q;/p;1 234;5 000;2%;3,5\n2026-07-08;;/p;;10;0%;\n", encoding="utf-8")
    got = S.read_csv(spark, str(p)).orderBy("query").collect()
    assert [(x["query"], x["clicks"], x["impressions"], x["position"]) for x in got] == [("", 0, 10, None), ("q", 1234, 5000, 3.5)]
    bad = tmp_path / "bad.csv"
    bad.write_text("Date,Query,Page,Clicks,Impressions,CTR,Position\n2026-07-08,q,/p,many,3,1%,2\n")
    with pytest.raises(Exception, match="not a number"):
        S.read_csv(spark, str(bad)).collect()


def test_read_rows_shapes(spark, tmp_path):
    row = {"date": "2026-07-08", "query": "q", "page": "/p", "clicks": 1, "impressions": 2, "position": 3.0}
    (tmp_path / "a.json").write_text(json.dumps({"rows": [row, row]}))
    (tmp_path / "b.json").write_text(json.dumps([row]))
    (tmp_path / "c.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps(row) + "\n")
    (tmp_path / "_manifest.json").write_text("{}")
    assert S.read_rows(spark, str(tmp_path)).count() == 5


def test_api_pages(spark, tmp_path):
    row = lambda i: {"keys": [f"q{i}"], "clicks": 1, "impressions": 2, "position": 3.0}
    (tmp_path / "2026-07-08-0.json").write_text(json.dumps({"rows": [row(0), row(1)]}))
    (tmp_path / "2026-07-08-1.json").write_text(json.dumps({"rows": [row(2)]}))
    pages.register(spark)
    got = spark.read.format("stored_pages").option("folder", str(tmp_path)).option("dates", "2026-07-08").option("pageSize", "2").load()
    assert got.count() == 3
    calls = []
    cut = list(pages.fetch(lambda d, s, n: calls.append(s) or [row(i) for i in range(n)], "2026-07-08", 2, 3))
    assert len(cut) == 3 and cut[-1]["truncated"] and calls == [0, 2]


def test_range_is_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    d = lambda i: dt.date(2026, 7, i)
    sinks.write_range(rows(spark, [(d(i), "q", "/p", 1, 2, 3.0) for i in (1, 2, 3)]), path, "2026-07-01", "2026-07-03")
    sinks.write_range(rows(spark, [(d(2), "r", "/p", 1, 2, 3.0)]), path, "2026-07-02", "2026-07-03")
    assert sorted((str(x["date"]), x["query"]) for x in spark.read.parquet(path).collect()) == [("2026-07-01", "q"), ("2026-07-02", "r")]


def test_mixed_script(spark):
    data = [("крeдит", True), ("баnк", True), ("Укpаїна", True), ("PDF-файл", False), ("IT-компанія", False), ("слово", False)]
    df = spark.createDataFrame(data, "t string, e boolean")
    assert all(x["e"] == (x["n"] > 0) for x in df.select("e", F.size(text.mixed_script(F.col("t"))).alias("n")).collect())


def test_text_functions(spark):
    one = spark.createDataFrame([("Straße  É​x", "0-306-40615-2", "978-0-306-40615-7", "10.1000/xyz")], "a string, b string, c string, d string")
    got = one.select(text.normalize_query(F.col("a")), text.isbn_valid(F.col("b")), text.isbn_valid(F.col("c")), text.doi_valid(F.col("d")), text.normalize_text(F.col("a"))).first()
    assert got[0] == "strasse éx" or got[0].startswith("strasse")
    assert got[1] and got[2] and got[3] and got[4] == "Straße Éx"
