"""Readers of files, checked inputs, and rules of drafts and the rule book on hand-made cases."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions.text import sentences
from larkspur.operators import drafts as D
from larkspur.operators import inputs as I
from larkspur.operators import lint as L
from larkspur.sources import files
from larkspur.sources.observations import HEADERS, read_csv


def test_config_and_brand(spark, tmp_path):
    (tmp_path / "a.yml").write_text("brand:\n  tokens: [Acme, acme, 'Big Co']\n")
    (tmp_path / "b.json").write_text('{"x": 1}')
    config = files.load_config(spark, f"file://{tmp_path}/a.yml")
    assert files.brand_tokens(config) == ["acme", "big co"] and files.brand_tokens("Acme # ours\n\n# none\nB") == ["acme", "b"]
    assert files.load_config(spark, f"file://{tmp_path}/b.json") == {"x": 1} and files.load_config(spark, f"file://{tmp_path}/none.yml") == {}


@pytest.mark.parametrize("text", ['{"/a": {"cluster": "c"}, "/b": {}}', '[{"url": "/a", "cluster": "c"}, {"url": "/b"}]', '{"pages": {"/a": {"cluster": "c"}, "/b": {}}}'])
def test_corpus(spark, text):
    assert sorted((x["url"], x["cluster"]) for x in files.read_corpus(spark, text).collect()) == [("/a", "c"), ("/b", None)]


def test_profiles(spark):
    for text in ('{"q": "aio", "r": {"aio": false}}', '[{"query": "q", "profile": "aio"}, {"query": "r"}]'):
        assert {x["query"]: x["profile"] for x in files.read_profiles(spark, text).collect()} == {"q": "aio", "r": "clean"}


def test_embeddings(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"/a": [1, 2]}')
    np.savez(tmp_path / "v.npz", **{"b": np.array([0.5, 1.5])})
    spark.createDataFrame([("c", [1.0])], "id string, vector array<float>").write.parquet(f"{tmp_path}/v.parquet")
    got = [files.read_embeddings(spark, f"{tmp_path}/v.{k}").first() for k in ("json", "npz", "parquet")]
    assert [(x["id"], x["vector"]) for x in got] == [("/a", [1.0, 2.0]), ("b", [0.5, 1.5]), ("c", [1.0])]


def test_folders(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>one</p>"), (tmp_path / "b.md").write_text("# two\nthree"), (tmp_path / "c.bin").write_text("x")
    assert {x["name"]: x["text"].strip() for x in files.read_snapshots(spark, str(tmp_path)).collect()} == {"a.html": "one", "b.md": "# two\nthree"}
    assert [(x["file"], x["line_no"], x["text"]) for x in files.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [("b.md", 1, "# two"), ("b.md", 2, "three")]
    found = {x["path"].rsplit("/", 1)[1]: x["found"] for x in files.read_manifest_files(spark, str(tmp_path)).collect()}
    assert found["c.bin"] == hashlib.sha256(b"x").hexdigest() == files.text_hash("x")


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><urlset><url><loc> https://x/a </loc><lastmod>2026-01-01</lastmod></url><url><loc>https://x/b</loc></url></urlset>')
    assert sorted(((x["url"], x["lastmod"]) for x in files.read_sitemap(spark, str(tmp_path / "s.xml")).collect())) == [("https://x/a", "2026-01-01"), ("https://x/b", None)]


def test_answers_and_adapter(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"engine": "e", "prompt_id": "p", "error": "timeout"}) + "\n")
    assert files.read_answers(spark, str(tmp_path / "a.jsonl")).first()["error"] == "timeout"
    (tmp_path / "p.jsonl").write_text(json.dumps({"ok": True, "result": {"items": [{"id": "1", "url": "/a"}]}}) + "\n")
    assert files.read_pages_of_adapter(spark, str(tmp_path / "p.jsonl")).first()["url"] == "/a"
    (tmp_path / "p.jsonl").write_text('{"ok": false, "error": "busy"}\n')
    with pytest.raises(Exception, match="busy"):
        files.read_pages_of_adapter(spark, str(tmp_path / "p.jsonl")).collect()


def test_parameters_and_flags(spark):
    df = spark.createDataFrame([("2026-01-01", True), ("2026-02-01", False)], "d string, is_x boolean")
    assert files.between(spark, "SELECT * FROM {rows} WHERE d BETWEEN :start AND :end", "2026-01-15", "2026-03-01", rows=df).count() == 1
    assert I.flag_columns(df) == ["is_x"]


@pytest.mark.parametrize("header", sorted(HEADERS))
def test_every_header(spark, tmp_path, header):
    base = {"date": "2026-01-01", "query": "q", "page": "/p", "clicks": "1", "impressions": "10", "position": "2", "ctr": "0.1", "country": "x", "device": "d"}
    names = {name: name for name in base} | {HEADERS[header]: header}
    (tmp_path / "x.csv").write_text(",".join(names.values()) + "\n" + ",".join(base.values()) + "\n")
    row = read_csv(spark, str(tmp_path / "x.csv")).first()
    assert (row["query"], row["page"], row["clicks"], row["impressions"], row["position"], row["country"], row["device"]) == ("q", "/p", 1, 10, 2.0, "x", "d")


def test_refused_inputs(spark):
    q = spark.createDataFrame([("1", "a", "en", "us"), ("1", "b", "en", "us")], "id string, text_norm string, lang string, geo string")
    with pytest.raises(I.InputError, match="duplicate"):
        I.graph_queries(q)
    with pytest.raises(I.InputError, match="lacks"):
        I.graph_queries(spark.createDataFrame([("1", None, "en", "us")], q.schema))
    mixed = I.graph_queries(spark.createDataFrame([("1", "a", "en", "us"), ("2", "b", "uk", "ua")], q.schema))
    with pytest.raises(I.InputError, match="mixed"):
        I.scoped(mixed)
    with pytest.raises(I.InputError, match="no query"):
        I.scoped(mixed, "de-de-desktop")
    assert I.scoped(mixed, "uk-ua-desktop").count() == 1
    with pytest.raises(I.InputError, match="pillar_source"):
        I.graph_queries(q.limit(1), pillars=spark.createDataFrame([("1", "p", "guessed")], "query_id string, pillar_id string, pillar_source string"))
    obs = spark.createDataFrame([("/x", None)], "page string, locale string")
    with pytest.raises(I.InputError, match="no locale"):
        I.with_locale(obs, [])
    assert I.with_locale(obs, [], ["en"]).first()["locale"] == "en"


def test_sentences_and_abbreviations(spark):
    df = spark.createDataFrame([("Dr. Who came, e.g. here. Так. напр. це... Ні! Yes? 好。 End",)], "t string")
    assert df.select(sentences(F.col("t"))).first()[0] == ["Dr. Who came, e.g. here.", "Так.", "напр. це...", "Ні!", "Yes?", "好。", "End"]


def test_a_clean_draft_blocks_nothing_and_never_passes(spark):
    raw = "Intro words here. More of them follow.\n\n## One\n\nA section begins well. It goes on [[claim:c1]].\n\n## Two\n\nAnother one ends it."
    drafts = spark.createDataFrame([(1, raw)], "draft int, raw string")
    units, t = D.parsed(drafts), D.limits()
    claims = spark.createDataFrame([(1, "c1", "fact", "https://x", "primary", 200, "first_party", "a1")], "draft int, id string, kind string, source_url string, source_tier string, http_status int, provenance string, artifact_id string").withColumn("published", F.lit("2026-01-01").cast("date")).withColumn("volatile", F.lit(False))
    briefs = drafts.select("draft", F.lit(False).alias("ymyl"), F.lit("2026-01-10").cast("date").alias("byline"), F.lit("2026-01-10").cast("date").alias("created"), F.lit(30).alias("words"), D.cited_claims(F.col("raw")).alias("cited"), F.array(F.lit("c1")).alias("mandated"))
    results = D.form_rules(units, t).unionByName(D.structure_rules(units, t, "(?i)^this")).unionByName(D.trace_rules(drafts)).unionByName(D.claim_rules(briefs, claims, t)).unionByName(D.identifier_rules(drafts))
    row = D.gate(results).first()
    assert row["blocked_by"] == [] and row["verdict"] == "REWORK" and row["unresolved"] == ["WRT-10", "WRT-11", "WRT-15"]


def test_capped_severity():
    assert D.capped("BLOCK", "deterministic") == "BLOCK" and D.capped("BLOCK", "observed") == "WARN" and D.capped("BLOCK", "deterministic", "INFO") == "INFO"
    assert D.capped("INFO", "deterministic", "BLOCK") == "INFO" and D.capped(None, "observed") == "WARN" and D.capped("loud", "x") == "WARN"


def test_clean_book_and_gate(spark):
    text = "| **WRT-01** | BLOCK | limit = 3 [source: a] |\n| **WRT-02** | WARN | none |\n\n```\nBLOCK ⟸ WRT-01..02, 03 (when n < 0.5)\nREWORK ⟸ 2\n```\n"
    lines = L.rows_of(spark, {"05-write.md": text})
    assert [x["detail"] for x in L.gate_rules(lines).collect()] == ["WRT-03"]
    assert L.rule_metadata(lines).count() == 0 and L.rule_owners(lines, {"WRT": "05-write.md"}).count() == 0 and L.threshold_provenance(lines).count() == 0
    assert L.exit_code(L.gate_rules(lines)) == 2 and L.exit_code(L.rule_metadata(lines), strict=True) == 0
