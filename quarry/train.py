"""Command line: trains on text instances and writes the model as one line of text.

python -m quarry.train --input data/part-* --output model [--l1 1.0] [--binary] [--local] [--state folder]
"""

from __future__ import annotations

import argparse

from quarry.operators import training
from quarry.session import session, ship
from quarry.sources import instances


def main(args: list[str] | None = None) -> training.Model:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--l1", type=float, default=1.0)
    parser.add_argument("--memory", type=int, default=10)
    parser.add_argument("--max-iterations", type=int, default=120)
    parser.add_argument("--max-line-search", type=int, default=20)
    parser.add_argument("--tolerance", type=float, default=1e-4)
    parser.add_argument("--binary", action="store_true", help="every feature's value is 1, and repeated ids add up")
    parser.add_argument("--local", action="store_true", help="keep unlabelled instances")
    parser.add_argument("--state", help="a folder of states, to resume from")
    given = parser.parse_args(args)
    spark = session("train")
    ship(spark)
    rows = instances.parse_text(spark.read.text(given.input))
    options = training.Options(given.memory, given.l1, given.max_line_search, given.max_iterations, given.tolerance, "sum" if given.binary else "last", given.local, given.binary)
    model = training.train(rows, options, given.state)
    training.write_model(spark, model, given.output)
    return model


if __name__ == "__main__":
    done = main()
    print(f"{done.reason} after {done.iterations} iterations and {done.evaluations} evaluations; value {done.values[-1]:.6f}")
