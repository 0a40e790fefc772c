"""Scripts in order of dependency: what a script reads is made before it where any script makes it."""

from __future__ import annotations

from plumbline.tsql import text


def _short(name: str) -> str:
    parts = name.lower().split(".")
    return ".".join(["dbo", *parts] if len(parts) == 1 else parts[-2:])


def made_and_read(sql: str) -> tuple[set[str], set[str]]:
    """`schema.table` of the objects that a script makes or fills, and of those it reads but doesn't make."""
    found = [s for s in text.statements(sql) if s.kind != "dynamic"]
    made = {_short(name) for s in found for name in (s.target, s.owner) if name and name[0] not in "#@"}
    read = {_short(n) for n in text.sources(text.tokens(text.clean(sql))) if n[0] not in "#@"}
    read |= {_short(s.query[0]) for s in found if s.kind == "insert_exec"}
    return made, read - made


def ordered(scripts: list[str]) -> list[int]:
    """Places of the scripts, sources first, in the given order otherwise. In a cycle the first script goes first."""
    told = [made_and_read(sql) for sql in scripts]
    makers: dict[str, set[int]] = {}
    for k, (made, _) in enumerate(told):
        for name in made:
            makers.setdefault(name, set()).add(k)
    before = [set().union(*(makers.get(n, set()) for n in read)) - {k} for k, (_, read) in enumerate(told)]
    after: list[set[int]] = [set() for _ in scripts]
    for k, sources in enumerate(before):
        for s in sources:
            after[s].add(k)
    waiting, out = dict(enumerate(map(len, before))), []
    while waiting:
        ready = [k for k, n in waiting.items() if n == 0] or [next(iter(waiting))]
        for k in ready:
            del waiting[k]
            for later in after[k] & waiting.keys():
                waiting[later] -= 1
        out += ready
    return out
