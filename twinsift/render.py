"""Results as text for people."""

from __future__ import annotations

from .functions.scalars import TIER_ORDER


def name_of(function: dict) -> str:
    inside = f" in {function['context']}" if function["chunkType"] == "block" and function.get("context") else ""
    return f"{function['functionName']}{inside}"


def place(function: dict) -> str:
    return f"{function['filePath']}:{function['startLine']}-{function['endLine']}"


def score(match: dict) -> str:
    return f"{match['similarity']} ({int((1 - match['distance']) * 100)}%, jaccard: {match['jaccard']:.2f})"


def query_text(result: dict) -> str:
    lines = [f"warning: {note}" for note in result["warnings"]]
    for function in result["functions"]:
        lines.append(f"{name_of(function)} {function['signature']}  {place(function)}")
        if not function["candidates"]:
            lines.append("  no similar functions")
        for at, candidate in enumerate(function["candidates"], 1):
            lines.append(f"  {at}. {name_of(candidate)}  {place(candidate)}  similarity {1 - candidate['distance']:.2f}, {score(candidate)}")
    lines.append(f"{len(result['functions'])} functions against {result['totalIndexed']} indexed")
    return "\n".join(lines)


def scan_text(result: dict) -> str:
    lines = [f"warning: {note}" for note in result["warnings"]]
    for tier in TIER_ORDER:
        own = [m for m in result["matches"] if m["similarity"] == tier]
        if own:
            lines.append(f"{tier}: {len(own)}")
            lines += [f"  {name_of(m['a'])}  {place(m['a'])}\n  {name_of(m['b'])}  {place(m['b'])}\n    {score(m)}" for m in own]
    lines.append(f"{result['pairsFound']} pairs in {result['chunksScanned']} chunks")
    return "\n".join(lines)


def table_text(result: dict) -> str:
    return "\n".join(f"{key}: {', '.join(map(str, value)) if isinstance(value, list) else value}" for key, value in result.items())


def duration(seconds: float) -> str:
    whole = int(seconds)
    return f"{whole}s" if whole < 60 else f"{whole // 60}m {whole % 60}s" if whole < 3600 else f"{whole // 3600}h {whole % 3600 // 60}m"
