"""python -m kinfold.plans.cli learned|rules|validate|profile ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kinfold.operators import profile as E
from kinfold.operators import validate as V
from kinfold.plans import linkage as L
from kinfold.sources import records as S


def _split(spark: SparkSession, folder: str, split: str):
    read = lambda n: S.canonical(S.read_tsv(spark, S.find_file(spark, folder, f"{split}_source{n}.tsv")))
    return read(1), S.catalogue(read(2), read(3))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinfold")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("learned")
    for name in ("--data", "--work", "--out"):
        a.add_argument(name, required=True)
    a.add_argument("--folds", type=int, default=3)
    a.add_argument("--rounds", type=int, default=60)
    a.add_argument("--threshold", type=float, default=0.70)
    a.add_argument("--train-queries", type=int, default=300_000)
    a = sub.add_parser("rules")
    a.add_argument("--data", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--split", choices=("train", "test"), default="test")
    a.add_argument("--threshold", type=float, default=0.50)
    a.add_argument("--most", type=int, default=30)
    a = sub.add_parser("validate")
    a.add_argument("--matching", required=True)
    a.add_argument("--candidate")
    a.add_argument("--test-dir", required=True)
    a.add_argument("--check-ids", action="store_true")
    a.add_argument("--strict", action="store_true")
    a = sub.add_parser("profile")
    a.add_argument("--data", required=True)
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    if o.what == "learned":
        s1, targets = _split(spark, o.data, "train")
        truth = S.truth_pairs(S.read_tsv(spark, S.find_file(spark, o.data, "train_ground_truth.tsv")), s1, targets)
        flow = L.Flow(trees=L.M.Trees(rounds=o.rounds), folds=o.folds, threshold=o.threshold, train_queries=o.train_queries)
        print(L.run_learned((s1, targets, truth), _split(spark, o.data, "test"), o.out, o.work, flow).facts())
    elif o.what == "rules":
        L.run_rules(*_split(spark, o.data, o.split), o.out, o.threshold, o.most)
    elif o.what == "validate":
        found = V.validate(spark, o.matching, o.candidate, f"{o.test_dir}/test_source1.tsv", tuple(f"{o.test_dir}/test_source{n}.tsv" for n in (2, 3)), o.check_ids, o.strict)
        found.show(100, False)
        return 0 if V.passed(found) else 1
    else:
        s1, targets = _split(spark, o.data, "train")
        truth = S.truth_lists(S.read_tsv(spark, S.find_file(spark, o.data, "train_ground_truth.tsv")))
        for df in (E.truth_summary(truth), E.truth_profile(truth), E.countries(s1.unionByName(targets)), E.scripts(s1.unionByName(targets)), E.exact_copies(s1.unionByName(targets))):
            df.show(50, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
