import json

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.functions import scalar, vocab
from graphloom.operators import build, traverse, typed
from graphloom.sources import ntriples, tokenizer

from . import golden


def _triples(spark):
    return ntriples.parse(spark.createDataFrame([(x,) for x in golden.lines()], "value string"))


def test_first_generation(spark):
    full, core = typed.first_generation(_triples(spark)), typed.first_generation(_triples(spark), decomposition=False)
    by = {r["pred"]: r["count"] for r in full.groupBy("pred").count().collect()}
    assert by == {1: 5, 2: 2, 3: 5, 4: 1, 5: 1, 6: 2, 7: 3, 8: 2, 9: 1}
    assert core.count() == full.count() - 5
    texts = {r["code"]: r["text"] for r in typed.first_generation_texts(_triples(spark)).collect()}
    assert texts[(5 << 56) | 200] == "oborožen spopad" and (8 << 56) | 5 in texts
    assert full.select(typed.predicate_label(F.col("pred")).alias("l")).filter("l is null").isEmpty()


def test_levi_sizes(spark):
    edges = spark.createDataFrame([(1, 2, "sense"), (2, 3, "usage"), (3, 4, "member")], "src long, dst long, rel string")
    labelled = typed.with_labels(edges)
    assert {r["label"] for r in labelled.collect()} == {"pomen", "zgled"}
    reached = traverse.balls(spark.createDataFrame([(1,)], "seed long"), build.half_edges(edges), 2)
    lens = spark.createDataFrame([(k, 10) for k in range(1, 5)], "node long, token_len int")
    got = {r["hop"]: r.asDict() for r in typed.levi_sizes(reached, labelled, lens, 2).collect()}
    assert (got[1]["levi_nodes"], got[1]["tokens"]) == (3, 45) and (got[2]["levi_nodes"], got[2]["tokens"]) == (5, 56)
    assert set(typed.VARIANTS) == {"expand_examples", "collapse_examples", "expand_noexamples", "collapse_noexamples"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "dump").mkdir()
    (tmp_path / "dump/a.nt").write_text("\n".join(golden.lines()), encoding="utf-8")
    dump, at, host = str(tmp_path / "dump"), str(tmp_path / "g"), vocab.HOSTS[0]
    assert cli.main(["build", "--kg-dir", dump, "--save-graph", at]) == 2 and cli.main(["build", "--kg-dir", dump, "--save-graph", at, "--host", "http://other/"]) == 1
    assert cli.main(["build", "--kg-dir", dump, "--save-graph", at, "--host", host, "--dump-samples", "1", "--no-analysis"]) == 0
    assert cli.main(["verify", at, "--samples", "1"]) == 0 and cli.main(["diff", at, at]) == 0
    out = str(tmp_path / "report.json")
    assert cli.main(["study", "--load-graph", at, "--out", out, "--n-seeds", "2", "--max-hops", "1", "--variants", "expand_examples_colloc"]) == 0
    told = json.load(open(out, encoding="utf-8"))
    assert "nodes" in told["variants"]["expand_examples_colloc"]["1"]["all"] and told["stats"]["member_sets"] == {"1": 1, "2": 2}
    assert cli.main(["first-generation", "--kg-dir", dump, "--host", host, "--no-decomp", "--out", out, "--n-seeds", "3", "--max-hops", "2"]) == 0
    told = json.load(open(out, encoding="utf-8"))
    assert "levi_nodes" in told["variants"]["no_decomp"]["2"]["all"] and "lexical-unit" in told["avg_composition"]["1"]
    capsys.readouterr()
    monkeypatch.setenv("GRAPHLOOM_STORE", at)
    assert cli.main(["word", "boj"]) == 0
    said = capsys.readouterr().out
    assert "exact" in said and "iztočnica: boj" in said and "not searched: sopomenka: 1" in said
    assert cli.main(["word", "boja", "--max", "1"]) == 0
    said = capsys.readouterr().out
    assert "an inflected form, not a headword" in said and "headwords of the best forms" in said
    assert cli.main(["word", "ničtakega"]) == 1 and cli.main(["word", "boj", "--also", "x"]) == 2
    assert cli.main(["id", "1", "--store", at, "--hops", "2"]) == 0 and cli.main(["id", "12345"]) == 1
    assert "hop 2" in capsys.readouterr().out
    assert cli.main(["raw-id", dump, "1"]) == 0 and cli.main(["raw-word", dump, "boj", "--lang", "sl"]) == 0


def test_second_generation(spark):
    extra = [f"<{golden.C}sense-1> <{vocab.VARTRANS}target> <{golden.C}translation-form-4> .", f"<{golden.C}lexical-unit-9> <{vocab.FRAC}head> <{golden.C}lexical-unit-1> ."]
    lines = spark.createDataFrame([(x,) for x in [*golden.lines(), *extra]], "value string")
    got = typed.second_generation(ntriples.parse(lines)).groupBy("rel").count().collect()
    assert {r["rel"]: r["count"] for r in got} == {"other": 2, "sense": 5, "syn": 2, "ant": 1, "usage": 2, "constituent": 2, "translation": 1, "head": 1}


def test_formatting(spark):
    r = spark.range(1).select(
        scalar.grouped(F.lit(1234567)).alias("n"), scalar.percent(F.lit(1), F.lit(8)).alias("p"), scalar.percent(F.lit(1), F.lit(0)).alias("none"), scalar.elapsed(F.lit(3725.9)).alias("t")
    ).first()
    assert tuple(r) == ("1,234,567", "12.5 %", "", "1:02:05")


def test_token_lengths_by_files(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "boj proti"), (2, "boj proti"), (3, ""), (4, "The lexical unit")], "key int, text string")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {k: len(model.encode(t)) for k, t in ((1, "boj proti"), (2, "boj proti"), (3, ""), (4, "The lexical unit"))}
    for distinct in (True, False):
        got = build.with_token_lengths(df, tokenizer.lengths(path), distinct=distinct).collect()
        assert {r["key"]: r["token_len"] for r in got} == want
    files = (("byte_bpe_50k.json", None), ("byte_bpe_50k.tiktoken", tokenizers.PATTERN))
    both = [{r["key"]: r["token_len"] for r in build.with_token_lengths(df, tokenizer.lengths(tokenizers.path(f), p)).collect()} for f, p in files]
    assert both[0] == both[1]
