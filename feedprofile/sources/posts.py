"""Posts of feeds as rows, read from pieces of lines: no line is ever one row, however long it is.

Files are cut at quotation marks, so that a row is the text between two of them and tasks take blocks of a file whatever
lines they hold. Where a block starts inside a line, what its first piece is depends on all before it: inside a string or
not, and how deep in arrays. The first pass runs each block from every possible start, up to its first line feed, after
which all agree; the driver strings the blocks' effects together (a few numbers a block); the second pass knows its start.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedprofile.sources.shared import kept

_NUMBER = re.compile(r":\s*(-?\d+)")
#: Strings longer than this are no key.
KEY = 8


@dataclass
class Place:
    """Where a scan is: ``members`` and ``posts`` count commas of the outer and the inner array. None is "as before the block"."""

    inside: bool = False
    depth: int = 0
    record: int = 0
    members: int | None = 0
    posts: int | None = 0
    last: str | None = ""
    id: str | None = ""
    #: Commas met while the count before is unknown.
    more_members: int = 0
    more_posts: int = 0
    #: The string's former pieces; only the second pass holds them.
    held: str | None = None
    awaits_id: bool = False

    def structure(self, s: str) -> None:
        """Text outside of strings, without line feeds."""
        t = s.strip()
        if t == ",":
            self._comma()
            return
        if t.startswith(":") and self.last == "id":
            number = _NUMBER.match(t)
            self.awaits_id = number is None and t == ":"
            if number:
                self.id = number[1]
        for c in t:
            if c == "[":
                self.depth += 1
                if self.depth == 1:
                    self.members, self.more_members = 0, 0
                elif self.depth == 2:
                    self.posts, self.more_posts = 0, 0
            elif c == "]":
                self.depth -= 1
            elif c == ",":
                self._comma()

    def _comma(self) -> None:
        if self.depth == 1:
            self.more_members += 1
        elif self.depth == 2:
            self.more_posts += 1

    def string(self, s: str) -> None:
        self.last = s if len(s) <= KEY else ""
        if self.awaits_id:
            self.id, self.awaits_id = s, False

    def feed(self, s: str) -> list[tuple[int, int, str]]:
        """Take the text up to the next quotation mark; returns strings as (record, depth, text) and ids as (record, -1, id)."""
        before, found = self.id, []
        if self.inside and "\n" not in s:
            whole = s if self.held is None else self.held + s
            if s.endswith("\\") and (len(s) - len(s.rstrip("\\"))) % 2:
                self.held = whole + '"'  # an escaped mark is part of the string
                return found
            self.held, self.inside = None, False
            self.string(whole)
            found.append((self.record, self.depth, whole))
        else:
            head, *rest = s.split("\n")
            if not self.inside:
                self.structure(head)
            self.inside = True
        if self.id != before and self.id:
            found.append((self.record, -1, self.id))
        if "\n" in s:
            self.__dict__.update(Place(record=self.record + len(rest), inside=True).__dict__)
            self.structure(rest[-1])
        return found

    def after(self, before: Place) -> Place:
        """This effect of a block, behind the place where the block starts."""
        known = lambda own, more, past: past + more if own is None else own + more
        return replace(
            self, record=before.record + self.record, members=known(self.members, self.more_members, before.members), posts=known(self.posts, self.more_posts, before.posts),
            more_members=0, more_posts=0, last=before.last if self.last is None else self.last, id=before.id if self.id is None else self.id, held=None,
        )


def _starts() -> list[Place]:
    """Every way in which a block may start: inside a string or not, and the depth of arrays."""
    return [Place(inside=i, depth=d, members=None, posts=None, last=None, id=None, awaits_id=a) for i in (False, True) for d in (0, 1, 2) for a in (False, True)]


def _blocks(batches) -> Iterator[tuple[str, int, list[str]]]:
    """Pieces of a task in order, by file and block."""
    for batch in batches:
        files, blocks, pieces = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
        at = 0
        while at < len(pieces):
            to = at
            while to < len(pieces) and blocks[to] == blocks[at] and files[to] == files[at]:
                to += 1
            yield files[at], blocks[at], pieces[at:to]
            at = to


_EFFECT = "file string, block long, start int, place string"


def _effects(batches):
    """Of each block, what it does to every possible start."""
    here, places, merged, fragment = None, [], False, []

    def rows():
        out = [{"file": here[0], "block": here[1], "start": k, "place": json.dumps({**p.__dict__, "held": p.held is not None})} for k, p in enumerate(places)]
        return pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("block", pa.int64()), ("start", pa.int32()), ("place", pa.string())]))

    for file, block, pieces in _blocks(batches):
        if (file, block) != here:
            if here is not None:
                yield rows()
            here, places, merged = (file, block), _starts(), False
        for s in pieces:
            if not merged and "\n" in s:
                for p in places:
                    p.feed(s)
                # from here on all starts agree
                places, merged = places[:1], True
                continue
            for p in places:
                p.feed(s)
                if p.held is not None:
                    p.held = ""  # that it goes on matters, not what it is
    if here is not None:
        yield rows()


def _strung(effects: list) -> dict[tuple[str, int], dict]:
    """The place where each block starts, from the effects of all blocks of its file."""
    found: dict[tuple[str, int], dict[int, dict]] = {}
    for r in effects:
        found.setdefault((r["file"], r["block"]), {})[r["start"]] = json.loads(r["place"])
    starts: dict[tuple[str, int], dict] = {}
    now = Place()
    for k, (file, block) in enumerate(sorted(found)):
        ways = found[file, block]
        if k == 0 or file != last_file:
            now, goes_on = Place(), False
        last_file = file
        starts[file, block] = {**now.__dict__, "held": goes_on}
        chosen = ways[0] if len(ways) == 1 else ways[int(now.inside) * 6 + min(max(now.depth, 0), 2) * 2 + int(now.awaits_id)]
        goes_on = bool(chosen["held"])
        now = Place(**{**chosen, "held": None}).after(now)
    return starts


_POST = "file string, record long, id string, member int, post int, text string, block long, open boolean, goes_on boolean"


def _posts(starts: dict, level: int):
    """Posts with their place; those of a block that begins or ends within one are fragments."""

    def text(raw: str) -> str:
        return json.loads(f'"{raw}"', strict=False) if "\\" in raw else raw

    def run(batches):
        here, now, carried = None, None, False
        names = ["file", "record", "id", "member", "post", "text", "block", "open", "goes_on"]
        types = pa.schema([("file", pa.string()), ("record", pa.int64()), ("id", pa.string()), ("member", pa.int32()), ("post", pa.int32()), ("text", pa.string()), ("block", pa.int64()), ("open", pa.bool_()), ("goes_on", pa.bool_())])

        def row(place, raw, first, more):
            members, posts = (place.members or 0) + place.more_members, (place.posts or 0) + place.more_posts
            return (here[0], place.record, place.id or None, members if level == 2 else 0, posts if level == 2 else members, raw if first or more else text(raw), here[1], more, first)

        def ends():
            """A string that the next block goes on with."""
            if now is not None and now.held is not None and now.depth == level:
                yield row(now, now.held, carried, True)

        out: list[tuple] = []
        for file, block, pieces in _blocks(batches):
            if (file, block) != here:
                out += ends()
                here = (file, block)
                start = dict(starts[here])
                carried = bool(start.pop("held"))
                now = Place(**{**start, "held": "" if carried else None})
            for s in pieces:
                for record, depth, raw in now.feed(s):
                    if depth < 0:
                        out.append((file, record, raw, None, None, None, block, False, False))
                    elif depth == level:
                        out.append(row(now, raw, carried, False))
                    carried = carried and depth < 0
                carried = carried and now.inside and now.held is not None
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.types, strict=True)], names)
                out = []
        out += ends()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.types, strict=True)], names)

    return run


def read_posts(spark: SparkSession, path: str, feed: str = "members") -> DataFrame:
    """Rows ``(id, member, post, text)`` of a feed's non-null posts, with the numbers from 0 that they have in their arrays.

    The same posts as those of ``read_feeds``, from lines of ``{"id": number or string, "text": [[...]]}`` (``[...]`` for an
    own feed) in any order of keys, beside which scalar values may stand; arrays and objects elsewhere in a record are not
    understood. A line feed always ends a record, so that a broken line spoils itself only: what stands before its fault is
    kept. Posts of a record without an id have a null one.
    """
    if feed not in ("members", "own"):
        raise ValueError(f"feed must be 'members' or 'own', not {feed!r}")
    pieces = spark.read.option("lineSep", '"').text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    starts = _strung(pieces.mapInArrow(_effects, _EFFECT).collect())  # at most twelve short rows for each block of the files
    rows = kept(pieces.mapInArrow(_posts(starts, 2 if feed == "members" else 1), _POST))
    posts = rows.where("text IS NOT NULL")
    whole = posts.where("NOT open AND NOT goes_on").select("file", "record", "id", "member", "post", "text")
    # posts that lie in several blocks: two fragments for each block at most
    parts = posts.where("open OR goes_on").groupBy("file", "record", "member", "post").agg(F.max("id").alias("id"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"), F.min("open").alias("open"))
    raw = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    joined = parts.where("NOT open").select("file", "record", "id", "member", "post", F.from_json(F.concat(F.lit('{"t":"'), raw, F.lit('"}')), "t string", {"allowUnescapedControlChars": "true"})["t"].alias("text"))
    every = whole.unionByName(joined)
    # ids that stand behind the posts of their record
    late = rows.where("text IS NULL").groupBy("file", "record").agg(F.max("id").alias("late"))
    early = every.where("id IS NOT NULL").select("id", "member", "post", "text")
    found = every.where("id IS NULL").join(late, ["file", "record"], "left").select(F.col("late").alias("id"), "member", "post", "text")
    return early.unionByName(found).withColumn("id", F.expr("try_cast(id as long)"))
