"""python -m facteng run PROGRAM [--facts FILE]...: evaluates a program text and prints its outputs or answers."""

from __future__ import annotations

import argparse
import os
import sys

from .errors import ProgramError
from .program import Program


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="facteng")
    p.add_argument("command", choices=["run", "check"])
    p.add_argument("program")
    p.add_argument("--facts", action="append", default=[])
    p.add_argument("--all-relations", action="store_true")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--certify", action="store_true")
    p.add_argument("--proofs", choices=["trees", "ordered-graph"])
    p.add_argument("--error-format", choices=["text", "json"], default="text")
    a = p.parse_args(args)
    say = lambda e: print(e.to_json() if a.error_format == "json" else str(e), file=sys.stderr)
    try:
        with open(a.program) as f:
            program = Program(f.read(), os.path.dirname(a.program))
        for path in a.facts:
            with open(path) as f:
                program.load_facts(f.read())
        if a.command == "check":
            for w in program.checked()[2]:
                say(w)
            return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
        result = program.evaluate(spark)
        for w in result.warnings:
            say(w)
        for name in result.outputs(a.all_relations):
            print("\n".join(result.render(name)))
        for k in range(len(program.queries)):
            print("\n".join(result.answers(k)))
        if a.proofs:
            from .sources.proofs import export

            print(export(result, form=a.proofs))
        if a.stats:
            print(result.stats(), file=sys.stderr)
        if a.certify:
            from .verify import verify

            found = verify(result)
            for x in found:
                say(ProgramError("E0955", x))
            return int(bool(found))
        return 0
    except ProgramError as e:
        say(e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
