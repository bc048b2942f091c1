"""Command line: preprocess listings, run a method, export and check its groups, compare finished runs.

    python -m samewise preprocess --input listings.parquet --out work
    python -m samewise run --input listings.parquet --out work --method local_tfidf [--threshold 0.9] [--no-form] [--exact] [--records r.parquet] [--offline] [--reuse] [--previous groups.csv]
    python -m samewise export --input listings.xlsx --groups work/lexical/groups.csv --out groups.xlsx
    python -m samewise checks --input listings.parquet --groups work/lexical/groups.csv
    python -m samewise compare work/lexical/report.json work/local_tfidf/report.json --out work
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from samewise.operators import attributes as A
from samewise.operators import evaluate as E
from samewise.operators import labels as L
from samewise.operators import mining as M
from samewise.plans import pipeline as P
from samewise.session import cut, importable
from samewise.sources import io
from samewise.sources import records as R


def preprocess(spark: SparkSession, source: str, out: str) -> None:
    tables = P.preprocess(io.read_listings(spark, source))
    for name, df in tables.items():
        io.write_table(df, f"{out}/{name}.parquet")
    done = {name: spark.read.parquet(f"{out}/{name}.parquet") for name in tables}
    io.check_order(A.latest(io.read_listings(spark, source)), done["processed"])
    io.write_manifest(f"{out}/manifest.json", done, {"input": source} | {name: f"{out}/{name}.parquet" for name in tables})


def run(spark: SparkSession, source: str, paths: io.Paths, config: P.Config, previous: str | None, reuse: bool = False) -> dict:
    """A whole run; with ``reuse`` a finished one in the same folder is reported again instead."""
    if reuse and Path(paths.of("report.json")).exists():
        return json.loads(Path(paths.of("report.json")).read_text())
    listings = io.read_listings(spark, source)
    out = P.run(listings, config, io.read_previous(spark, previous) if previous else None)
    groups = io.groups_table(out["clusters"], out["ids"], out["names"], out["attributes"], config.method, io.dataset_sha256(spark, source))
    io.write_table(groups, paths.of("groups.csv"))
    io.write_table(io.candidate_scores_table(out["scores"]), paths.of("candidate_pairs.csv"))
    io.write_table(out["lineage"], paths.of("group_lineage.csv"))
    if out["curve"] is not None:
        io.write_table(io.metrics_rows(out["curve"]), paths.of("curve.csv"), one_file=True)
    for name, text in out["models"].items():
        io.write_json(paths.of(f"models/{name.replace(' ', '_')}.json"), json.loads(text))
    io.write_json(paths.of("report.json"), out["report"])
    return out["report"]


def compare(spark: SparkSession, reports: list[str], out: str) -> str | None:
    """Metrics of finished runs, gated; writes metrics.csv and metrics.json and returns the best method's name."""
    rows = []
    for path in reports:
        r = json.loads(Path(path).read_text())
        m = r["metrics"]
        rows.append((r["method"], float(r["threshold"]), *[float(m[k]) for k in ("recall", "merge_rate", "precision", "pack_invariance", "candidate_recall")], int(m["n_groups"]), float(sum(r["timings"].values()))))
    df = spark.createDataFrame(rows, "method string, threshold double, recall double, merge_rate double, precision double, pack_invariance double, candidate_recall double, n_groups int, seconds double")
    gated = E.gate(df)
    best = E.best_method(gated).first()
    io.write_table(io.metrics_rows(gated), f"{out}/metrics.csv", one_file=True)
    io.write_json(f"{out}/metrics.json", {"best_method": best.method if best else None, "methods": [r.asDict() for r in gated.collect()]})
    return best.method if best else None


def export(spark: SparkSession, source: str, groups: str, out: str) -> int:
    return io.export_workbook(io.read_listings(spark, source), spark.read.csv(groups, header=True), out)


def checks(spark: SparkSession, source: str, groups: str) -> list[dict]:
    """The seven regression checks of finished groups, as rows of check and faults."""
    attrs = A.build_attributes(io.read_listings(spark, source))
    attrs = cut(attrs)
    pos = cut(L.positives(attrs))
    terms = cut(M.term_lists(attrs))
    sigs = M.signatures(terms, M.vocabulary(terms))
    found = E.regression_checks(spark.read.csv(groups, header=True), attrs, pos, L.negatives(attrs, pos), L.pack_invariance(attrs, sigs))
    return [r.asDict() for r in found.collect()]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="samewise", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("preprocess", "run"):
        c = commands.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--out", required=True)
    r = commands.choices["run"]
    r.add_argument("--method", default="local_tfidf", choices=P.METHODS)
    r.add_argument("--threshold", type=float)
    r.add_argument("--no-form", action="store_true")
    r.add_argument("--ann", action="store_true", help="neighbours from the inverted file: the default, accepted for callers that say so")
    r.add_argument("--exact", action="store_true", help="compare all vectors instead of probing the inverted file")
    r.add_argument("--dims", type=int, default=P.Config.dims)
    r.add_argument("--offline", action="store_true", help="ask no service: vectors, descriptors and records come from their tables only")
    r.add_argument("--reuse", action="store_true", help="take a finished run's report from its folder")
    r.add_argument("--records", help="parquet with sku_id, text and json of extracted records; for the methods that call services")
    r.add_argument("--previous")
    r.add_argument("--vectors", help="parquet with sku_id and vector, for the methods that need a service's vectors")
    r.add_argument("--descriptors", help="parquet with sku_id, dhash, hue and structure")
    for name, wants in (("export", ("--input", "--groups", "--out")), ("checks", ("--input", "--groups"))):
        c = commands.add_parser(name)
        for w in wants:
            c.add_argument(w, required=True)
    c = commands.add_parser("compare")
    c.add_argument("reports", nargs="+")
    c.add_argument("--out", required=True)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("samewise").getOrCreate()
    importable(spark)
    if a.command == "preprocess":
        preprocess(spark, a.input, a.out)
    elif a.command == "compare":
        print(compare(spark, a.reports, a.out))
    elif a.command == "export":
        print(export(spark, a.input, a.groups, a.out))
    elif a.command == "checks":
        print(json.dumps(checks(spark, a.input, a.groups), ensure_ascii=False))
    else:
        table = lambda path: spark.read.parquet(path) if path else None
        records = R.validate(R.parse(table(a.records))) if a.records else None
        if a.offline and a.method in ("semantic", "semantic_image", "hybrid_fusion") and not a.vectors:
            raise SystemExit(f"{a.method} needs --vectors when offline")
        config = P.Config(method=a.method, use_form=not a.no_form, use_ann=not a.exact, threshold=a.threshold, dims=a.dims, records=records, vectors=table(a.vectors), descriptors=table(a.descriptors))
        print(json.dumps(run(spark, a.input, io.Paths(a.out, a.method, not a.no_form, not a.exact, records is not None), config, a.previous, a.reuse)))


if __name__ == "__main__":
    main()
