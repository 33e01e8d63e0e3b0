"""Runs scripts: binds arguments, keeps variables, calls operations and user functions."""

from __future__ import annotations

import argparse
import logging
import os
from collections import Counter
from typing import Any

from pyspark.sql import SparkSession
from pyspark.storagelevel import StorageLevel

from ..operators.surfaces import PADDING, Surfaces
from ..sources import sinks
from ..sources.ifc import Files
from ..voxels import Voxels
from .language import Function, Name, Script, Statement, parse
from .registry import Operation, Scope, lookup

log = logging.getLogger("latticeworks")

DEFAULTS = {"VOXELSIZE": 0.05, "CHUNKSIZE": 128, "THREADS": 1, "PADDING": PADDING}


def type_name(v: Any) -> str:
    if isinstance(v, bool) or isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "real"
    if isinstance(v, str):
        return "string"
    if isinstance(v, list):
        return "sequence"
    if isinstance(v, Voxels):
        return "voxels"
    if isinstance(v, Surfaces):
        return "surfaceset"
    return "ifcfile" if isinstance(v, Files) else "nothing"


def bind(op: Operation, statement: Statement, variables: dict[str, Any]) -> dict[str, Any]:
    """Argument values by name, checked against the operation's."""
    given: dict[str, Any] = {}
    keyword = False
    for i, a in enumerate(statement.args):
        if keyword and a.keyword is None:
            raise TypeError("Keyword argument supplied after positional argument")
        keyword = a.keyword is not None
        if keyword:
            if a.keyword in given:
                raise TypeError(f"Value for {a.keyword} supplied multiple times")
            given[a.keyword] = a.value
        else:
            if i >= len(op.args):
                raise TypeError("Too many positional arguments")
            given[op.args[i].name] = a.value

    def resolve(v: Any) -> Any:
        if isinstance(v, Name):
            if v not in variables:
                raise NameError(f"Not defined: {v}")
            return variables[v]
        return v

    out = {}
    for arg in op.args:
        if arg.name not in given:
            if arg.required:
                raise TypeError(f"No value supplied for {arg.name}")
            continue
        value = resolve(given.pop(arg.name))
        if "*" not in arg.types and type_name(value) not in arg.types:
            raise TypeError(f"Expected value of type {' or '.join(sorted(arg.types))}, got {type_name(value)}")
        out[arg.name] = value
    for name, v in given.items():
        if not op.catch_all:
            raise TypeError(f"Keyword argument {name} unused")
        out[name] = resolve(v)
    return out


class Interpreter:
    """Variables and functions of a run. Operations are lazy: only counts, checks, sinks and loops start jobs."""

    def __init__(self, spark: SparkSession, variables: dict[str, Any] | None = None, save_to: str | None = None):
        self.spark, self.save_to = spark, save_to
        self.variables = DEFAULTS | (variables or {})
        self.functions: dict[str, Function] = {}
        self.uses: Counter[str] = Counter()

    def run(self, script: Script) -> Any:
        """Statements in order; the last one's value."""
        self.functions |= script.functions
        # grids that several statements read are kept, so that each is made once
        self.uses = Counter(str(a.value) for s in script.statements for a in s.args if isinstance(a.value, Name))
        last = None
        for s in script.statements:
            last = self.execute(s, self.variables)
        return last

    def execute(self, s: Statement, variables: dict[str, Any]) -> Any:
        log.info("%s", s)
        if s.op in self.functions:
            value = self._call_statement(self.functions[s.op], s, variables)
        else:
            op = lookup(s.op)
            own = bind(op, s, variables)
            scope = Scope(self.spark, own, {} if op.only_local else variables, lambda f, more: self.call(f, more, variables))
            value = op.run(scope)
            if s.op == "free":
                variables.pop(str(s.args[0].value), None)
        if s.target:
            if isinstance(value, Voxels) and variables is self.variables:
                if self.uses[s.target] > 1:
                    value = value.with_df(value.df.persist(StorageLevel.MEMORY_AND_DISK))
                if self.save_to:
                    sinks.save(value, os.path.join(self.save_to, s.target))
            variables[s.target] = value
        return value

    def _call_statement(self, f: Function, s: Statement, variables: dict[str, Any]) -> Any:
        from .registry import Arg

        op = Operation(f.name, tuple(Arg(p, frozenset("*")) for p in f.params), lambda scope: None)
        return self.call(f.name, bind(op, s, variables), variables)

    def call(self, name: str, args: dict[str, Any], variables: dict[str, Any]) -> Any:
        """Runs a user function over a copy of the variables."""
        if name not in self.functions:
            raise KeyError(f"No function named {name}")
        f = self.functions[name]
        local = {**variables, **args}
        for s in f.body:
            self.execute(s, local)
        if f.result is None:
            return None
        if f.result not in local:
            raise NameError(f"Not defined: {f.result}")
        return local[f.result]


def run_script(spark: SparkSession, text: str, **variables: Any) -> Any:
    """The value of a script's last statement."""
    return Interpreter(spark, variables).run(parse(text))


def run(spark: SparkSession, name: str, *args: Any, **keywords: Any) -> Any:
    """One operation, called with values."""
    op = lookup(name)
    context = DEFAULTS | {"CHUNKSIZE": 16, "THREADS": os.cpu_count() or 1}
    own = {op.args[i].name: v for i, v in enumerate(args)} | {k: v for k, v in keywords.items() if k not in context}
    context |= {k: v for k, v in keywords.items() if k in context}
    for a in op.args:
        if a.required and a.name not in own:
            raise TypeError(f"No value supplied for {a.name}")
    return op.run(Scope(spark, own, context))


def main(argv: list[str] | None = None) -> int:
    """Command line: run a script file."""
    p = argparse.ArgumentParser(prog="latticeworks", description="Runs a script of lattice operations.")
    p.add_argument("script")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-l", "--log-file")
    p.add_argument("-t", "--threads", type=int, default=1)
    p.add_argument("-d", "--size", type=float, default=DEFAULTS["VOXELSIZE"])
    p.add_argument("-c", "--chunk", type=int, default=DEFAULTS["CHUNKSIZE"])
    p.add_argument("-p", "--padding", type=int, default=PADDING)
    p.add_argument("--no-vox", action="store_true", help="don't save each grid")
    p.add_argument("--with-pointcloud", action="store_true", help="write each grid's points as well")
    p.add_argument("--mmap", action="store_true", help="accepted; Spark spills by itself")
    p.add_argument("--mesh", action="store_true", help="accepted; use the mesh operation")
    p.add_argument("--output", default=".", help="folder of saved grids")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.ERROR if a.quiet else logging.INFO, filename=a.log_file, format="[%(asctime)s] [%(levelname)s] %(message)s")
    with open(a.script, encoding="utf-8") as f:
        text = f.read()
    spark = SparkSession.builder.master(f"local[{a.threads}]").appName("latticeworks").getOrCreate()
    try:
        it = Interpreter(spark, {"VOXELSIZE": a.size, "CHUNKSIZE": a.chunk, "THREADS": a.threads, "PADDING": a.padding}, None if a.no_vox else a.output)
        value = it.run(parse(text))
        if a.with_pointcloud:
            for n, v in it.variables.items():
                if isinstance(v, Voxels):
                    sinks.export_point_cloud(v, os.path.join(a.output, f"{n}.points"))
        if not a.quiet:
            print(sinks.stats({"result": value})["result"])
    except Exception as e:  # the exit status tells
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
