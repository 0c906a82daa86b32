"""Analyzers: which there are, which run on a repository, and how their results become one.

An analyzer has metadata and turns a relation of files into a scan of all repositories at once. The built-in ones deal the
files by suffix; others come from installed packages by entry point. ``detect``, if an analyzer has it, says where it
runs: a truth value for all repositories, or a relation of those (repo) that it wants.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, fields
from importlib.metadata import entry_points
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import extract
from factloom.operators.signals import Result, merge_results
from factloom.sources.adapters import Scan

log = logging.getLogger(__name__)
GROUP = "factloom.analyzers"
PREFIX = "factloom-analyzer-"


@dataclass(frozen=True)
class Metadata:
    name: str
    display_name: str = ""
    version: str = "0.1.0"
    description: str = ""
    scope: str = ""
    targets: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    priority: int = 100
    experimental: bool = True
    enabled_by_default: bool = False

    @property
    def ecosystems(self) -> tuple[str, ...]:
        """Languages, then targets, in lower case, each once."""
        return tuple(dict.fromkeys(x.lower() for x in (*self.languages, *self.targets)))


class Analyzer(Protocol):
    metadata: Metadata

    @property
    def name(self) -> str: ...

    def analyze(self, files: DataFrame) -> Scan | Result: ...


def metadata_of(value: object) -> Metadata:
    """Metadata from itself, a mapping, or any object's attributes.

    The older key ``ecosystems`` stands for languages where neither languages nor targets are given; the display name is
    the name where none is given.
    """
    if isinstance(value, Metadata):
        return value
    names = [f.name for f in fields(Metadata)]
    given = dict(value) if isinstance(value, Mapping) else {k: getattr(value, k) for k in (*names, "ecosystems") if hasattr(value, k)}
    older = given.pop("ecosystems", None)
    if older and not given.get("languages") and not given.get("targets"):
        given["languages"] = older
    if not isinstance(given.get("name"), str) or not given["name"].strip():
        raise ValueError("metadata needs a name")
    if unknown := given.keys() - set(names):
        log.debug("unknown metadata of %s: %s", given["name"], sorted(unknown))
    own = {k: tuple(v) if k in ("targets", "languages") else v for k, v in given.items() if k in names}
    return Metadata(**own | {"display_name": given.get("display_name") or given["name"]})


@dataclass(frozen=True)
class SuffixAnalyzer:
    """A built-in analyzer: what the patterns find in the files of its suffixes."""

    metadata: Metadata
    suffixes: tuple[str, ...]

    @property
    def name(self) -> str:
        return self.metadata.name

    def analyze(self, files: DataFrame) -> Result:
        own = extract.accepted(files, self.suffixes)
        binary = dict(own.dtypes)["content"] == "binary"
        return Result(extract.scan_files(extract.decoded(own) if binary else own), extract.scanned(own))


# Names, targets, languages and priorities of the built-in analyzers, in the order in which they run.
BUILT_IN = (
    SuffixAnalyzer(Metadata("python-web", "Python web", description="Routes and signals of Python web code.", scope="Python files", targets=("fastapi", "flask"), languages=("python",), priority=20, experimental=False, enabled_by_default=True), (".py",)),
    SuffixAnalyzer(Metadata("javascript-web", "JavaScript web", description="Routes and signals of JavaScript web code.", scope="JavaScript files", targets=("express", "node"), languages=("javascript",), priority=20, experimental=False, enabled_by_default=True), (".js",)),
    SuffixAnalyzer(Metadata("default", "Default", description="Routes and signals of what no other built-in analyzer reads.", scope="TypeScript files", languages=("typescript",), experimental=False, enabled_by_default=True), (".ts", ".tsx")),
)

#: The patterns one family at a time, without lines: a relation of files to a relation of facts.
FILE_ANALYZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "routes": lambda f: extract.extract_routes(f).select("repo", "path", "method", "file", "line"),
    "external_calls": lambda f: extract.extract_calls(f).select("repo", "target", "file"),
    "databases": lambda f: extract.extract_databases(f).select("repo", "kind", "file"),
    "auth": lambda f: extract.extract_auth(f).select("repo", "hint", "file", F.lit(0.7).alias("confidence")),
    "secrets": lambda f: extract.extract_secrets(f).select("repo", "name", "file"),
}


def valid(candidate: Any) -> bool:
    name = getattr(candidate, "name", None)
    return callable(getattr(candidate, "analyze", None)) and hasattr(candidate, "metadata") and isinstance(name, str) and bool(name.strip())


def instance(loaded: Any) -> Any:
    """An analyzer from what an entry point holds: a class, an analyzer, or a function that makes one."""
    if isinstance(loaded, type) or callable(loaded) and not (hasattr(loaded, "analyze") and hasattr(loaded, "metadata")):
        return loaded()
    return loaded


def discovered(candidates: Iterable[Any] | None = None) -> list[Any]:
    """Installed analyzers by the name of their entry points; those that can't be loaded, made or described are skipped with
    a warning."""
    out = []
    for point in sorted(entry_points(group=GROUP) if candidates is None else candidates, key=lambda p: p.name):
        try:
            made = instance(point.load())
            known = metadata_of(getattr(made, "metadata", None))
        except Exception as failure:  # noqa: BLE001 - a plug-in may fail in any way
            log.warning("analyzer %s is skipped: %s", point.name, failure)
            continue
        try:
            made.metadata = known
        except Exception:  # noqa: BLE001 - read-only metadata is fine as it is
            log.debug("metadata of %s can't be set", point.name)
        if valid(made):
            out.append(made)
        else:
            log.warning("analyzer %s is skipped: it has no name or nothing to run", point.name)
    return out


def registered(candidates: Iterable[Any] | None = None) -> list[Any]:
    """Built-in analyzers, then installed ones; of a name, the first."""
    out: dict[str, Any] = {}
    for a in (*BUILT_IN, *discovered(candidates)):
        if a.name in out:
            log.warning("another analyzer is named %s already", a.name)
        out.setdefault(a.name, a)
    return list(out.values())


def short_name(module: str) -> str:
    """An analyzer's name from how it is asked for: a name, package, or repository, with or without address and ending."""
    return module.strip().lower().removesuffix(".git").rstrip("/").rsplit("/", 1)[-1].removeprefix(PREFIX)


def package_name(module: str) -> str:
    return PREFIX + short_name(module)


def install(package: str) -> None:
    """Packages aren't fetched from here."""
    raise RuntimeError(f"{package} isn't installed; install it with your package manager and try again")


def selected(requested: Iterable[str], auto_install: bool = False, installer: Callable[[str], None] = install, candidates: Callable[[], Iterable[Any]] | None = None) -> list[Any]:
    """The analyzers asked for, each once, in the order asked; an error names all that there aren't."""
    names = list(dict.fromkeys(short_name(m) for m in requested if m.strip()))
    if not names:
        return []
    known = lambda: {a.name: a for a in registered(candidates() if candidates else None)}
    there = known()
    if auto_install and (missing := [n for n in names if n not in there]):
        for name in missing:
            try:
                installer(package_name(name))
            except Exception as failure:
                raise ValueError(f"analyzer {name} couldn't be installed: {failure}") from failure
        there = known()
    if missing := [n for n in names if n not in there]:
        raise ValueError(f"there are no analyzers named {', '.join(missing)}")
    return [there[n] for n in names]


def listing(spark: SparkSession, analyzers: Iterable[Any] | None = None) -> DataFrame:
    """Metadata of the registered analyzers, in their order, with ecosystems."""
    rows = []
    for place, a in enumerate(registered() if analyzers is None else analyzers, 1):
        m = metadata_of(a.metadata)
        rows.append((place, *asdict(m).values(), list(m.ecosystems)))
    kinds = "name string, display_name string, version string, description string, scope string, targets array<string>, languages array<string>, priority int, experimental boolean, enabled_by_default boolean"
    return spark.createDataFrame([tuple(list(x) if isinstance(x, tuple) else x for x in r) for r in rows], f"place int, {kinds}, ecosystems array<string>")


def remote(payload: str | list[Any]) -> list[dict[str, str]]:
    """Analyzers among the repositories of an organisation: name, package and link of those with the packages' prefix, by
    name. payload: the listing as JSON or already read; nothing is fetched from here."""
    if isinstance(payload, str):
        try:
            payload = json.loads(payload)
        except json.JSONDecodeError as failure:
            raise ValueError(f"the listing isn't JSON: {failure}") from failure
    if not isinstance(payload, list):
        raise ValueError("the listing isn't a list of repositories")
    rows = [(str(x.get("name", "")).strip(), str(x.get("html_url", "")).strip()) for x in payload if isinstance(x, Mapping)]
    return sorted(({"name": short_name(n), "package": n, "link": link} for n, link in rows if n.startswith(PREFIX)), key=lambda r: r["name"])


def runs_on(analyzer: Any, files: DataFrame) -> DataFrame | None:
    """The files that an analyzer runs on, None if it doesn't: all of them without detect; a failing detect says no."""
    detect = getattr(analyzer, "detect", None)
    if not callable(detect):
        return files
    try:
        wanted = detect(files)
    except Exception as failure:  # noqa: BLE001 - a plug-in may fail in any way
        log.warning("detect of analyzer %s failed: %s", analyzer.name, failure)
        return None
    if isinstance(wanted, DataFrame):
        return files.join(wanted.select("repo").distinct(), "repo", "left_semi")
    return files if wanted else None


def analyze(files: DataFrame, analyzers: Iterable[Any] | None = None) -> Result:
    """What the analyzers (else all registered ones) find in files, as one result; every repository of files is in it."""
    results = []
    for a in registered() if analyzers is None else analyzers:
        own = runs_on(a, files)
        if own is not None:
            found = a.analyze(own)
            results.append(found if isinstance(found, Result) else Result(found, extract.scanned(extract.accepted(own)).limit(0)))
    return merge_results(results, files.select("repo").distinct())
