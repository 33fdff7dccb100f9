"""Command line: python -m quillmill STAGE --root FOLDER [options]; the stages are those of plans.stages."""

from __future__ import annotations

import argparse
import importlib
import sys
from dataclasses import MISSING, fields

from .functions.tokenizers import HubTokenizer, WordTokenizer
from .operators import generation
from .plans import stages
from .session import session

STAGES = {
    "ingest": (stages.run_ingest, stages.IngestConfig, False),
    "profile": (stages.run_profile, stages.ProfileConfig, False),
    "registers": (stages.run_registers, None, False),
    "briefs": (stages.run_briefs, stages.BriefRunConfig, True),
    "dataset": (stages.run_dataset, stages.DatasetConfig, True),
    "burrows": (stages.run_burrows, stages.BurrowsConfig, False),
    "classifier": (stages.run_classifier, stages.ClassifierConfig, False),
    "eval-briefs": (stages.run_eval_briefs, stages.EvalConfig, False),
    "generate": (stages.run_generate, generation.GenerationConfig, False),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillmill", description=__doc__)
    sub = top.add_subparsers(dest="stage", required=True)
    for name, (f, config, takes_tokenizer) in STAGES.items():
        p = sub.add_parser(name, help=(f.__doc__ or "").strip().partition("\n")[0])
        p.add_argument("--root", required=True)
        p.add_argument("--master", default=None)
        if takes_tokenizer:
            p.add_argument("--tokenizer", default=None, help="a tokenizer's JSON file; words without one")
        if name in ("briefs", "generate"):
            p.add_argument("--provider", default=None, help="module:function that makes a provider from the parameters")
        for x in fields(config) if config else ():
            many = x.default == ()
            kind = int if x.name == "seed" else str if x.default in (MISSING, None, ()) else type(x.default)
            p.add_argument(f"--{x.name.replace('_', '-')}", type=kind, default=None if x.default is MISSING else x.default, required=x.default is MISSING, **({"nargs": "*"} if many else {}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    f, config, takes_tokenizer = STAGES[args["stage"]]
    more = []
    if config:
        more.append(config(**{x.name: tuple(v) if isinstance(v := args[x.name], list) else v for x in fields(config)}))
    if takes_tokenizer:
        more.append(HubTokenizer(args["tokenizer"]) if args["tokenizer"] else WordTokenizer())
    if args.get("provider"):
        module, _, function = args["provider"].partition(":")
        more.append(getattr(importlib.import_module(module), function))
    out = f(session(args["master"]), args["root"], *more)
    out.show(1000, truncate=60)
    return int(args["stage"] == "registers" and not out.where("NOT valid").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
