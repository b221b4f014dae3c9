"""python -m turfline train --cards FILE... --artifacts FOLDER, or score --cards FILE --artifacts FOLDER --out FOLDER."""

import argparse
import json
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession

from turfline.config import OLDER_SELECTION, SelectionConfig
from turfline.plans import train


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="turfline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("train", "score"):
        command = commands.add_parser(name)
        command.add_argument("--cards", required=True, nargs="+" if name == "train" else None)
        command.add_argument("--artifacts", required=True)
        if name == "score":
            command.add_argument("--out", required=True)
        else:
            command.add_argument("--selection", choices=("current", "older"), default="current")
            command.add_argument("--trees", type=int, default=SelectionConfig().trees, help="at most, for the selection; validation rows stop it earlier")
            command.add_argument("--permutation-repeats", type=int, default=SelectionConfig().permutation_repeats, help="0: no permutation importance")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"turfline {given.command}").getOrCreate()
    if given.command == "train":
        rules = OLDER_SELECTION if given.selection == "older" else SelectionConfig()
        config = replace(rules, trees=given.trees, permutation=given.permutation_repeats > 0, permutation_repeats=given.permutation_repeats)
        print(json.dumps(train.train_from_cards(spark, given.cards, given.artifacts, config).report, indent=2, default=str))
    else:
        train.score_cards(spark, given.cards, given.artifacts, given.out)


if __name__ == "__main__":
    main()
