"""The compact stream format with string references; read only."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from waymill.sources.xmlfile import parsed_files

# Fixed values of the format.
_NODE, _WAY, _RELATION, _RESET, _END, _TABLE, _LONGEST = 0x10, 0x11, 0x12, 0xFF, 0xFE, 15_000, 250


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.reset()

    def reset(self) -> None:
        self.strings: list[bytes] = []
        self.last = {"id": 0, "time": 0, "changeset": 0, "lon": 0, "lat": 0, "ref": 0, "n": 0, "w": 0, "r": 0}

    def number(self) -> int:
        value = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    def signed(self) -> int:
        value = self.number()
        return -(value >> 1) - 1 if value & 1 else value >> 1

    def step(self, name: str) -> int:
        self.last[name] += self.signed()
        return self.last[name]

    def strings_of(self, n: int) -> list[bytes]:
        """A group of n zero-ended strings, here or by reference to a recent one."""
        back = self.number()
        if back:
            whole = self.strings[-back]
        else:
            end = self.at
            for _ in range(n):
                end = self.data.index(b"\0", end) + 1
            whole = self.data[self.at : end]
            self.at = end
            if len(whole) <= _LONGEST + n:
                self.strings.append(whole)
                if len(self.strings) > 2 * _TABLE:
                    del self.strings[:_TABLE]
        return whole.split(b"\0")[:n]

    def info(self) -> dict:
        out = {"version": self.number(), "timestamp": None, "changeset": 0, "uid": 0, "user": ""}
        if out["version"]:
            seconds = self.step("time")
            if seconds:
                out["timestamp"] = datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
                out["changeset"] = self.step("changeset")
                back = self.number()
                if back:
                    pair = self.strings[-back]
                    uid, _, user = pair.partition(b"\0")
                    user = user[:-1]
                else:
                    begin = self.at
                    end = begin
                    while self.data[end] & 0x80:
                        end += 1
                    end += 1
                    uid = self.data[begin:end]
                    stop = self.data.index(b"\0", end + 1)
                    user = self.data[end + 1 : stop]
                    self.at = stop + 1
                    self.strings.append(uid + b"\0" + user + b"\0")
                value = shift = 0
                for byte in uid:
                    value |= (byte & 0x7F) << shift
                    shift += 7
                out["uid"], out["user"] = value, user.decode("utf-8", "replace")
        return out

    def tags(self, end: int) -> list[dict]:
        out = []
        while self.at < end:
            k, v = self.strings_of(2)
            out.append({"k": k.decode("utf-8", "replace"), "v": v.decode("utf-8", "replace")})
        return out


def parse(data: bytes) -> Iterator[dict]:
    """Objects of a file in its order."""
    r, seq = _Reader(data), 0
    while r.at < len(data):
        kind = data[r.at]
        r.at += 1
        if kind == _RESET:
            r.reset()
            continue
        if kind == _END:
            return
        if kind >= 0xF0:
            continue
        size = r.number()
        end = r.at + size
        if kind not in (_NODE, _WAY, _RELATION):
            r.at = end
            continue
        row = {"type": "nwr"[kind - _NODE], "id": r.step("id"), "visible": True, "lon_e7": None, "lat_e7": None, "refs": None, "members": None, "tags": [], "_seq": seq} | r.info()
        if r.at >= end:  # nothing follows: deleted
            row["visible"] = False
            if kind == _WAY:
                row["refs"] = []
            elif kind == _RELATION:
                row["members"] = []
        elif kind == _NODE:
            row["lon_e7"], row["lat_e7"] = r.step("lon"), r.step("lat")
        else:
            stop = r.number()
            stop += r.at
            if kind == _WAY:
                row["refs"] = []
                while r.at < stop:
                    row["refs"].append({"ref": r.step("ref"), "lon_e7": None, "lat_e7": None})
            else:
                row["members"] = []
                while r.at < stop:
                    step = r.signed()
                    (text,) = r.strings_of(1)
                    member = "nwr"[text[0] - 48]
                    r.last[member] += step
                    row["members"].append({"type": member, "ref": r.last[member], "role": text[1:].decode("utf-8", "replace")})
        row["tags"] = r.tags(end)
        r.at = end
        seq += 1
        yield row


def read(spark: SparkSession, path: str, src: int = 0) -> DataFrame:
    """Objects of all files of a path; one task for each."""
    return parsed_files(spark, path, parse, src)
