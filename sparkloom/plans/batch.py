"""Several questions in one request: a declarative plan is checked, run in order, and answered in one envelope. No code runs."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

#: The tools of a plan and their arguments; a type of one element is required.
TOOLS = {
    "semantic_search": {"query": (str,), "limit": int, "min_score": float, "worktree_id": str, "file_pattern": str, "exclude_pattern": str, "language": str, "code_only": bool},
    "find_files": {"pattern": (str,), "worktree_id": str},
    "get_symbols": {"name": str, "file_path": str, "kind": str, "limit": int, "worktree_id": str},
    "get_file_summary": {"path": (str,), "worktree_id": str},
    "get_recent_changes": {"query": str, "limit": int, "since": str},
    "get_dependencies": {"path": (str,), "recursive": bool, "max_files": int, "worktree_id": str},
    "find_importers": {"target": (str,), "limit": int, "worktree_id": str},
    "find_references": {"symbol": (str,), "file_path": str, "include_declaration": bool, "include_context": bool, "context_lines": int, "limit": int, "worktree_id": str},
    "status": {},
}
MOST_CALLS = 8


def arguments(tool: str, args: dict) -> dict:
    """A tool's arguments in its own spelling: ``filePath`` and ``file_path`` are the same, the first counts.

    Unknown ones, and optional ones of another type, are left out; a required text that is missing or blank is an error.
    Numbers must be finite and are cut to whole ones where the tool wants those.
    """
    out = {}
    for name, kind in TOOLS[tool].items():
        needed, kind = (True, kind[0]) if isinstance(kind, tuple) else (False, kind)
        head, *rest = name.split("_")
        values = [args[k] for k in (head + "".join(x.title() for x in rest), name) if k in args]
        fits = [v for v in values if (isinstance(v, kind) if kind in (str, bool) else isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v))]
        if needed and not (fits and fits[0].strip()):
            raise ValueError(f"{tool}: the text {name!r} is missing")
        if fits:
            out[name] = kind(fits[0])
    return out


def check_plan(plan, most: int = MOST_CALLS) -> list[dict]:
    """The calls of a plan: a list, or an object with ``calls``, or either as JSON; ValueError says what is wrong."""
    if isinstance(plan, str):
        plan = json.loads(plan)
    calls = plan.get("calls") if isinstance(plan, dict) else plan
    if not isinstance(calls, list) or not 1 <= len(calls) <= most:
        raise ValueError(f"a plan has 1 to {most} calls")
    for i, c in enumerate(calls):
        if not isinstance(c, dict) or c.get("tool") not in TOOLS:
            raise ValueError(f"call {i}: the tool must be one of {', '.join(TOOLS)}")
        if not isinstance(c.get("args", {}), dict):
            raise ValueError(f"call {i}: args must be an object")
    return [{"tool": c["tool"], "args": arguments(c["tool"], c.get("args", {}))} for c in calls]


def _call(engine, tool: str, args: dict):
    """The engine's answer to one call; its own names of the arguments are set here."""
    if tool == "semantic_search":
        names = {"file_pattern": "include", "exclude_pattern": "exclude"}
        return engine.semantic_search(**{names.get(k, k): v for k, v in args.items()})
    if tool == "get_file_summary":
        return engine.file_summary(**args)
    if tool == "get_dependencies":
        return engine.get_dependencies(args["path"], args.get("recursive", False), args.get("max_files", 50), args.get("worktree_id"))
    if tool == "find_references":
        rows, note = engine.find_references(None, args["symbol"], args.get("file_path"), args.get("limit", 50), args.get("worktree_id"), declarations=args.get("include_declaration", False))
        return (engine.in_context(rows, args.get("context_lines", 2), args.get("worktree_id")) if args.get("include_context") else rows), note
    return getattr(engine, tool)(**args)


def _plain(x):
    if isinstance(x, DataFrame):
        return [r.asDict(True) for r in x.collect()]  # tools limit their rows
    if isinstance(x, tuple):
        return [_plain(y) for y in x]
    return x


def run_plan(engine, plan, most: int = MOST_CALLS, threads: int = 1) -> dict:
    """{"ok": True, "calls_executed", "results"} in the plan's order, or {"ok": False, "error"}."""
    try:
        calls = check_plan(plan, most)
        with ThreadPoolExecutor(threads) as pool:
            results = list(pool.map(lambda c: {"tool": c["tool"], "result": _plain(_call(engine, c["tool"], c["args"]))}, calls))
        return {"ok": True, "calls_executed": len(calls), "results": results}
    except Exception as e:  # the envelope carries any error of a call
        return {"ok": False, "error": str(e)}


def format_results(rows: list[dict], most_lines: int = 48) -> str:
    """Search results as text: place, score to three decimals, and the content cut to so many lines."""
    out = []
    for i, r in enumerate(rows, 1):
        body = (r.get("content") or r.get("chunk") or "").split("\n")
        cut = body[:most_lines] + (["..."] if len(body) > most_lines else [])
        out.append(f"{i}. {r['path']}:{r['start_line']}-{r['end_line']} (score {r.get('final_score', r.get('score', 0)):.3f})\n" + "\n".join(cut))
    return "\n\n".join(out) or "no results"


def format_references(rows: list[dict], note: dict) -> str:
    """References as text under what was asked for and what really ran."""
    head = [f"backend: {note['actual']} (asked: {note['requested']}), confidence {note['confidence']}"]
    if note.get("reason"):
        head.append(f"because {note['reason']}")
    if note["actual"] == "heuristic":
        head.append("these are word matches; they may include other symbols of that name")
    if not rows and note.get("candidates"):
        head.append("did you mean: " + ", ".join(note["candidates"]))
    return "\n".join(head + [f"{r['path']}:{r['line']}: {r['text']}" for r in rows])


def format_status(status: dict) -> str:
    """The status report as sections of lines."""
    lines = [f"files {status['files']}, chunks {status['chunks']}, symbols {status['symbols']}"]
    lines += [f"  {k}: {n}" for k, n in status["languages"].items()]
    g = status["graph"]
    lines.append(f"graph: {g['resolved']} of {g['total']} resolved ({g['rate']:.1%})")
    lines += [f"  {k}: p50 {v['p50']:.0f} ms, p95 {v['p95']:.0f} ms of {v['n']}" for k, v in status["latency"].items()]
    if status["warning"]:
        lines.append(f"warning: {status['warning']}")
    return "\n".join(lines)


def format_summary(s: dict) -> str:
    parts = [f"[file] {s['path']}", f"[state] {s['state']}", f"[chunks] {s['chunks']}"]
    parts += [f"[{k}] " + ", ".join(s[k]) for k in ("symbols", "imports") if s[k]]
    parts += [f"[{k}] {s[k]}" for k in ("package", "doc") if s.get(k)]
    return "\n".join(parts)
