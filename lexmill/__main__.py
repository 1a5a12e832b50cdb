"""python -m lexmill train INPUT FOLDER | encode MODEL INPUT OUTPUT | bench MODEL [INPUT]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import codec, report, train
from .operators.vocab import Vocabulary
from .sources import files


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    learn = commands.add_parser("train", help="learn a vocabulary from a .bz2 dump, a file of lines or a folder of .txt files")
    learn.add_argument("input")
    learn.add_argument("folder")
    learn.add_argument("--vocab-size", type=int, default=300_000)
    learn.add_argument("--min-frequency", type=int, default=2)
    learn.add_argument("--max-articles", type=int, default=None)
    apply = commands.add_parser("encode", help="write the ids of every document as Parquet")
    apply.add_argument("model")
    apply.add_argument("input")
    apply.add_argument("output")
    bench = commands.add_parser("bench", help="tokens, characters and speed over a corpus or the texts that come along")
    bench.add_argument("model")
    bench.add_argument("input", nargs="?")
    bench.add_argument("--iterations", type=int, default=1)
    chosen = parser.parse_args(args)

    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    try:
        if chosen.command == "train":
            corpus = files.read_corpus(spark, chosen.input, chosen.max_articles)
            vocab = train.train(corpus, chosen.vocab_size, chosen.min_frequency)
            vocab.save(chosen.folder)
            print(f"{vocab.num_merges} merges, vocabulary of {vocab.vocab_size}, in {chosen.folder}")
            return 0
        vocab = Vocabulary.load(chosen.model)
        if chosen.command == "encode":
            codec.encode(files.read_corpus(spark, chosen.input), vocab).write.parquet(chosen.output)
        else:
            corpus = files.read_corpus(spark, chosen.input) if chosen.input else files.benchmark_texts(spark)
            print(json.dumps(report.benchmark(corpus, vocab, chosen.model, chosen.iterations)))
        return 0
    except FileNotFoundError as gone:
        print(f"not found: {gone}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
