"""Command line: build, study, verify, diff and look up.

    python -m graphloom.cli build --kg-dir DIR --save-graph STORE --host https://example.org/
    python -m graphloom.cli study --load-graph STORE --n-seeds 400 --max-hops 3 --out report.json
    python -m graphloom.cli first-generation --kg-dir DIR --host https://example.org/ --no-decomp --out report.json
    python -m graphloom.cli verify STORE | diff NEW OLD | word beseda --store STORE --also pomen | id 12 --store STORE --hops 2

Commands that read a store take the one that the variable GRAPHLOOM_STORE names if none is given.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar, vocab
from .operators import build, lookup, sizing, store, traverse, typed
from .plans.staging import staged
from .sources import ntriples, tokenizer


def _study_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--n-seeds", type=int, default=400)
    p.add_argument("--max-hops", type=int, default=3)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--prompt-tokens", type=int, default=24)
    p.add_argument("--variants", type=lambda x: x.split(","))
    p.add_argument("--out", help="report of the study")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--workers", type=int, help="threads of a local session")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--kg-dir")
    where = b.add_mutually_exclusive_group(required=True)
    where.add_argument("--save-graph")
    where.add_argument("--load-graph", help="study a stored graph instead of building one")
    b.add_argument("--host", action="append", help="prefix of the data's own names; may repeat")
    b.add_argument("--files-limit", type=int)
    b.add_argument("--sense-snippet", type=int, default=60)
    b.add_argument("--no-sense-index", action="store_true")
    b.add_argument("--colloc-text", choices=("phrase", "pair"), default="phrase")
    b.add_argument("--unit-feature", action="append", help="feature of a unit to render; default: aspect, clitic")
    b.add_argument("--tokenizer", help="file of a tokenizer, by which token lengths are measured")
    b.add_argument("--no-tokenizer", action="store_true", help="a quarter of the characters, whatever --tokenizer says")
    b.add_argument("--no-analysis", action="store_true", help="no study after the build")
    b.add_argument("--dump-samples", type=int, default=0)
    _study_flags(b)
    s = sub.add_parser("study")
    s.add_argument("--load-graph", default=store.default_path())
    _study_flags(s)
    f = sub.add_parser("first-generation")
    f.add_argument("--kg-dir", required=True)
    f.add_argument("--host", action="append", required=True)
    f.add_argument("--no-decomp", action="store_true", help="without the two predicates of decomposition")
    f.add_argument("--files-limit", type=int)
    _study_flags(f)
    v = sub.add_parser("verify")
    v.add_argument("store", nargs="?", default=store.default_path())
    v.add_argument("--samples", type=int, default=0, help="texts of every kind to print")
    d = sub.add_parser("diff")
    d.add_argument("new")
    d.add_argument("old")
    for name, what in (("word", str), ("id", int)):
        w = sub.add_parser(name)
        w.add_argument("what", type=what)
        w.add_argument("--store", default=store.default_path())
        w.add_argument("--max", type=int, default=25)
        if name == "word":
            w.add_argument("--also", action="append", default=[])
            w.add_argument("--rank-cap", type=int, default=lookup.RANK_CAP)
        else:
            w.add_argument("--hops", type=int, default=1)
    for name, what in (("raw-iri", str), ("raw-id", int), ("raw-word", str)):
        r = sub.add_parser(name)
        r.add_argument("kg_dir")
        r.add_argument("what", type=what)
        r.add_argument("--host", default=vocab.HOSTS[0])
        r.add_argument("--lang")
        r.add_argument("--max", type=int, default=40)
    return top


def report(rows: DataFrame, meta: dict) -> dict:
    """Nested report of a study: variants -> hop -> seed kind -> metric -> figures. The rows are a few hundred at most."""
    out: dict = {"meta": meta, "variants": {}}
    for r in rows.collect():
        figures = {k: v for k, v in r.asDict().items() if k not in ("variant", "hop", "seed_kind", "metric")}
        at = out["variants"].setdefault(r["variant"], {}).setdefault(str(r["hop"]), {}).setdefault(r["seed_kind"], {})
        at[r["metric"]] = figures
    return out


def _show(rows: DataFrame, most: int) -> int:
    """Prints at most `most` rows and how many more there are; the number of rows."""
    n = rows.count()
    for r in rows.limit(most).collect():
        print("\t".join("" if v is None else str(v) for v in r))
    if n > most:
        print(f"... {n - most} more")
    return n


TIERS = ("exact", "whole word", "part of a word")


def show_word(found: lookup.Lexicon, word: str, also: list[str], rank_cap: int, most: int) -> int:
    """Prints matches by kind and tier, headwords of the best forms, a note and the totals of other kinds; their number."""
    names = {kind: name for name, kind in reversed(vocab.KIND_NAMES.items())}
    ranked = staged(found.word(word, also, rank_cap), "ranked")
    total = 0
    for kind in sorted({*lookup.BASE_KINDS, *lookup.kinds_named(also)}):
        rows = ranked.filter(F.col("kind") == kind)
        n = rows.count()
        total += n
        if not n:
            continue
        print(f"{names[kind]}: {n:,}")
        last = None
        for r in rows.orderBy("tier", "label").limit(most).collect():
            if r["tier"] != last:
                print(f"  {TIERS[r['tier']]}")
            last = r["tier"]
            print(f"    {r['label']}\t{r['text']}")
        if n > most:
            print(f"    ... {n - most:,} more")
    if ranked.filter(F.col("kind") == vocab.FORM).limit(1).count():
        print("headwords of the best forms")
        _show(found.headwords(found.best_forms(ranked)).select("headword", "text").distinct().orderBy("headword"), most)
    if found.inflected_only(ranked).first()[0]:
        print(f"{word}: an inflected form, not a headword")
    others = found.unsearched(word, also).collect()  # a row a kind
    for r in others:
        print(f"not searched: {names[r['kind']]}: {r['nodes']:,}")
    return total + sum(r["nodes"] for r in others)


def _study(spark: SparkSession, args, path: str) -> None:
    graph, manifest = store.load(spark, path)
    nodes = graph.nodes.select(F.col("key").alias("node"), "kind", "token_len")
    seeds = sizing.sample(sizing.seed_pool(graph.nodes), "seed", args.n_seeds, args.seed)
    rows = sizing.study(nodes, graph.half_edges, staged(seeds, "seeds"), args.max_hops, args.prompt_tokens, args.variants)
    meta = {"n_seeds": args.n_seeds, "seed": args.seed, "max_hops": args.max_hops, "prompt_tokens": args.prompt_tokens} | manifest["meta"]
    _write(args.out, report(rows, meta) | {"stats": manifest["build"]})


def _write(path: str | None, what: dict) -> None:
    text = json.dumps(what, ensure_ascii=False, indent=1)
    if path is None:
        print(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def _first_generation(spark: SparkSession, args) -> None:
    """Report of the typed, undirected graph: Levi sizes of balls and their composition by type."""
    triples = ntriples.parse(ntriples.read_lines(spark, args.kg_dir, args.files_limit))
    edges = staged(typed.first_generation(triples, tuple(args.host), not args.no_decomp), "typed")
    texts = staged(typed.first_generation_texts(triples, tuple(args.host)), "texts")
    labelled = edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), typed.predicate_label(F.col("pred")).alias("label"))
    half = staged(build.half_edges(labelled), "half-edges")
    nodes = half.select(F.col("src").alias("node")).distinct().join(texts.select(F.col("code").alias("node"), "text"), "node", "left")
    nodes = staged(nodes.select("node", scalar.type_of(F.col("node")).alias("type_id"), scalar.token_proxy(F.col("text")).alias("token_len")), "nodes")
    seeds = staged(sizing.sample(sizing.seed_pool(nodes, 1), "seed", args.n_seeds, args.seed), "seeds")
    reached = traverse.balls(seeds.select("seed"), half, args.max_hops)
    sizes = typed.levi_sizes(reached, labelled, nodes.select("node", "token_len"), args.max_hops)
    metrics = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("orig_nodes", "induced_edges", "levi_nodes", "tokens")]
    rows = sizes.select("hop", F.explode(F.array(*metrics)).alias("m")).select("hop", "m.metric", "m.value")
    figures = sizing.summary(rows, "value", ["hop", "metric"]).withColumns({"variant": F.lit("no_decomp" if args.no_decomp else "all"), "seed_kind": F.lit("all")})
    names = F.create_map(*[F.lit(x) for pair in vocab.TYPE_NAMES.items() for x in pair])
    shown = [vocab.TYPE_NAMES[vocab.TYPES[x]] for x in ("lexical-unit", "word-form", "sense", "example")]
    parts = traverse.composition(reached, nodes.select("node", F.try_element_at(names, F.col("type_id")).alias("type")), args.max_hops, shown)
    out = report(figures, {"n_seeds": args.n_seeds, "seed": args.seed})
    out["avg_composition"] = {}
    for r in parts.collect():  # a few rows a hop
        out["avg_composition"].setdefault(str(r["hop"]), {})[r["type"]] = r["nodes_per_seed"]
    _write(args.out, out)


def _samples(nodes: DataFrame, n: int) -> None:
    short = nodes.select("kind", "key", F.substring("text", 1, 160).alias("text"))
    _show(traverse.capped(short, "kind", [F.col("key")], n).orderBy("kind", "key"), 9 * n)


def main(argv: list[str] | None = None) -> int:
    """0: done or found, 1: nothing found or a check failed, 2: unknown kind or wrong use."""
    args = _parser().parse_args(argv)
    session = SparkSession.builder.appName("graphloom")
    spark = (session.master(f"local[{args.workers}]") if args.workers else session).getOrCreate()
    if args.command == "build":
        if args.load_graph:
            _study(spark, args, args.load_graph)
            return 0
        if not args.kg_dir or not args.host:
            print("build needs --kg-dir and --host, the prefix of the data's own names", file=sys.stderr)
            return 2
        measured = bool(args.tokenizer) and not args.no_tokenizer
        lines = ntriples.read_lines(spark, args.kg_dir, args.files_limit)
        graph = build.build(
            ntriples.parse(lines), tuple(args.host), args.sense_snippet, not args.no_sense_index, args.colloc_text, tuple(args.unit_feature or vocab.UNIT_FEATURES),
            tokenizer.lengths(args.tokenizer) if measured else scalar.token_proxy, distinct_tokens=measured,
        )
        if graph.parts["found"].isEmpty():
            print("no triple of a known predicate lies under the given hosts", file=sys.stderr)
            return 1
        meta = {"sense_snippet": args.sense_snippet, "sense_index": not args.no_sense_index, "colloc_text": args.colloc_text, "files_limit": args.files_limit, "tokenizer": args.tokenizer if measured else None}
        print(json.dumps(store.save(graph, args.save_graph, meta), ensure_ascii=False))
        if args.dump_samples:
            _samples(store.load(spark, args.save_graph)[0].nodes, args.dump_samples)
        if not args.no_analysis and args.out:
            _study(spark, args, args.save_graph)
        return 0
    if args.command == "study":
        _study(spark, args, args.load_graph)
        return 0
    if args.command == "first-generation":
        _first_generation(spark, args)
        return 0
    if args.command == "verify":
        graph, manifest = store.load(spark, args.store)
        wrong = store.violations(graph, manifest).filter("found > 0")
        if args.samples:
            _samples(graph.nodes, args.samples)
        return 1 if _show(wrong, 100) else 0
    if args.command == "diff":
        new, old = (store.load(spark, p)[0] for p in (args.new, args.old))
        _show(store.differences(old.nodes, new.nodes, "key", "text", "kind").orderBy("kind"), 20)
        rules = store.text_rules(old, new).unionByName(store.edge_rules(old, new)).filter("found > 0 and check not like 'text changed%'")
        return 1 if _show(rules, 100) else 0
    if args.command == "word":
        found = lookup.Lexicon(store.load(spark, args.store)[0])
        try:
            return 0 if show_word(found, args.what, args.also, args.rank_cap, args.max) else 1
        except ValueError as wrong:
            print(wrong, file=sys.stderr)
            return 2
    if args.command == "id":
        graph, _ = store.load(spark, args.store)
        code = (vocab.TYPES["lexical-unit"] << vocab.TYPE_SHIFT) | args.what
        seed = graph.nodes.filter(F.col("code") == code).select(F.col("key").alias("seed"))
        reached = staged(traverse.balls(seed, graph.half_edges, args.hops), "ball")
        sizes = {r["depth"]: r["count"] for r in reached.groupBy("depth").count().collect()}  # a row a hop
        named = reached.join(graph.nodes.select(F.col("key").alias("node"), "text"), "node")
        for depth, n in sorted(sizes.items()):
            print(f"hop {depth}: {n:,}")
            _show(named.filter(F.col("depth") == depth).select("node", "text").orderBy("node"), args.max)
        return 0 if sizes else 1
    triples = ntriples.parse(ntriples.read_lines(spark, args.kg_dir, recursive=True))
    lexicon = lookup.Lexicon(None)
    if args.command == "raw-word":
        rows = lexicon.raw_word(triples, args.what, args.lang)
    elif args.command == "raw-id":
        rows = lexicon.raw_id(triples, args.what, args.host)
    else:
        rows = lexicon.raw(triples, args.what)
    return 0 if _show(rows, args.max) else 1


if __name__ == "__main__":
    sys.exit(main())
