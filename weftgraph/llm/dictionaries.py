"""Word lists of scripts written without spaces, from the public dictionaries that come with Spark's own ICU library.

The lists are tries in the library's documented binary format: of bytes (one script's letters, shifted) or of UTF-16 units,
where a final value is a word's cost (the rarer, the higher). They are read on the driver and sent to the tasks; a caller may
give lists of its own instead, one ``word[<tab>cost]`` a line.
"""

from __future__ import annotations

import glob
import os
import struct
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import SparkSession

FILES = {"thai": "thaidict.dict", "lao": "laodict.dict", "cjk": "cjdict.dict"}
FOLDER = "com/ibm/icu/impl/data/icudata/brkitr/"
#: A word of a list without costs, and a letter that no word covers.
PLAIN_COST, UNKNOWN_COST = 100, 255


def _resource(name: str, spark: SparkSession | None) -> bytes:
    """A file of the library, from the JVM's class path or, without a session, from the installed jar."""
    if spark is not None:
        stream = spark._jvm.java.lang.ClassLoader.getSystemResourceAsStream(FOLDER + name)
        if stream is None:
            stream = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream(FOLDER + name)
        if stream is not None:
            return bytes(stream.readAllBytes())
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in glob.glob(os.path.join(home, "jars", "icu4j-*.jar")):
        with zipfile.ZipFile(jar) as z:
            return z.read(FOLDER + name)
    raise FileNotFoundError(f"{name}: give the word lists yourself")


class _Reader:
    """Walks a trie of units: bytes, or UTF-16 units as a tuple of numbers."""

    def __init__(self, units: bytes | tuple[int, ...], letter: Callable[[int], str], wide: bool) -> None:
        self.u, self.letter, self.wide = units, letter, wide
        self.match, self.value = (0x30, 0x40) if wide else (0x10, 0x20)

    def _number(self, p: int, lead: int) -> tuple[int, int]:
        """A value that begins with ``lead`` and the place after it."""
        u = self.u
        if self.wide:
            if lead < 0x4000:
                return lead, p
            return (((lead - 0x4000) << 16) | u[p], p + 1) if lead < 0x7FFF else ((u[p] << 16) | u[p + 1], p + 2)
        if lead < 0x51:
            return lead - 0x10, p
        if lead < 0x6C:
            return ((lead - 0x51) << 8) | u[p], p + 1
        if lead < 0x7E:
            return ((lead - 0x6C) << 16) | (u[p] << 8) | u[p + 1], p + 2
        n = lead - 0x7B
        return int.from_bytes(u[p : p + n], "big"), p + n

    def _node_value(self, p: int, node: int) -> tuple[int, int]:
        if node < 0x4040:
            return (node >> 6) - 1, p
        return ((((node & 0x7FC0) - 0x4040) << 10) | self.u[p], p + 1) if node < 0x7FC0 else ((self.u[p] << 16) | self.u[p + 1], p + 2)

    def _jump(self, p: int) -> int:
        u, d = self.u, self.u[p]
        p += 1
        if self.wide:
            if d >= 0xFC00:
                d, p = ((u[p] << 16) | u[p + 1], p + 2) if d == 0xFFFF else (((d - 0xFC00) << 16) | u[p], p + 1)
        elif d >= 0xC0:
            if d < 0xF0:
                d, p = ((d - 0xC0) << 8) | u[p], p + 1
            elif d < 0xFE:
                d, p = ((d - 0xF0) << 16) | (u[p] << 8) | u[p + 1], p + 2
            else:
                n = d - 0xFB
                d, p = int.from_bytes(u[p : p + n], "big"), p + n
        return p + d

    def _skip(self, p: int) -> int:
        d = self.u[p]
        if self.wide:
            return p + 1 + (0 if d < 0xFC00 else 2 if d == 0xFFFF else 1)
        return p + 1 + (0 if d < 0xC0 else 1 if d < 0xF0 else 2 if d < 0xFE else d - 0xFB)

    def words(self) -> Iterator[tuple[str, int]]:
        u = self.u
        stack: list[tuple[str, int, int]] = [("", 0, -1)]  # a prefix, a place, the kind of node there if it was read
        while stack:
            text, p, node = stack.pop()
            while True:
                if node < 0:
                    node = u[p]
                    p += 1
                if node >= self.value:
                    final = bool(node & 0x8000) if self.wide else bool(node & 1)
                    if self.wide and not final:
                        v, p = self._node_value(p, node)
                        yield text, v
                        node &= 0x3F
                        continue
                    v, p = self._number(p, node & 0x7FFF if self.wide else node >> 1)
                    yield text, v
                    if final:
                        break
                    node = -1
                elif node >= self.match:
                    n = node - self.match + 1
                    text += "".join(map(self.letter, u[p : p + n]))
                    p, node = p + n, -1
                else:
                    if node == 0:
                        node = u[p]
                        p += 1
                    self._branch(text, p, node + 1, stack)
                    break

    def _branch(self, text: str, p: int, n: int, stack: list[tuple[str, int, int]]) -> None:
        u = self.u
        while n > 5:
            p += 1
            self._branch(text, self._jump(p), n >> 1, stack)
            n -= n >> 1
            p = self._skip(p)
        for _ in range(n - 1):
            key, node = self.letter(u[p]), u[p + 1]
            final = bool(node & 0x8000) if self.wide else bool(node & 1)
            v, q = self._number(p + 2, node & 0x7FFF if self.wide else node >> 1)
            if final:
                # A value node of its own: read again from its lead.
                stack.append((text + key, p + 1, -1))
            else:
                stack.append((text + key, q + v, -1))
            p = q
        stack.append((text + self.letter(u[p]), p + 1, -1))


def parse(content: bytes) -> list[tuple[str, int]]:
    """(word, cost) of a dictionary file."""
    header = struct.unpack(">H", content[:2])[0]
    index = struct.unpack(">8i", content[header : header + 32])
    body = content[header + index[0] : header + index[3]]
    if index[4] & 7 == 0:
        base = index[5] & 0x1FFFFF
        reader = _Reader(body, lambda b: "\u200d" if b == 0xFF else "\u200c" if b == 0xFE else chr(base + b), False)
    else:
        reader = _Reader(struct.unpack(f">{len(body) // 2}H", body[: len(body) // 2 * 2]), chr, True)
    return [(w.encode("utf-16", "surrogatepass").decode("utf-16"), v) for w, v in reader.words()]


@lru_cache(maxsize=2)
def _installed(with_session: bool) -> dict[str, str]:
    spark = SparkSession.getActiveSession() if with_session else None
    out = {}
    for script, name in FILES.items():
        words = parse(_resource(name, spark))
        costs = any(v for _, v in words)
        out[script] = "\n".join(f"{w}\t{v if costs else PLAIN_COST}" for w, v in words)
    return out


class Lexicon:
    """The word lists as automata, built where they are first needed."""

    def __init__(self, lists: dict[str, str]) -> None:
        self.lists = lists
        self._built: dict[str, object] = {}

    def __getstate__(self) -> dict[str, str]:
        return self.lists

    def __setstate__(self, lists: dict[str, str]) -> None:
        self.__init__(lists)

    def _automaton(self, script: str) -> object:
        if script not in self._built:
            import ahocorasick

            a = ahocorasick.Automaton()
            for line in self.lists[script].split("\n"):
                word, _, cost = line.partition("\t")
                if word:
                    a.add_word(word, (len(word), int(cost or PLAIN_COST)))
            if len(a):
                a.make_automaton()
            self._built[script] = a
        return self._built[script]

    def _by_automaton(self, run: str, script: str) -> list[str]:
        size = len(run)
        automaton = self._automaton(script)
        cost, back = [0] * (size + 1), list(range(-1, size))
        seen = 0  # costs up to here are known
        for last, (n, c) in automaton.iter(run) if len(automaton) else ():
            while seen <= last:
                cost[seen + 1] = cost[seen] + UNKNOWN_COST
                seen += 1
            begin = last + 1 - n
            if cost[begin] + c < cost[seen]:
                cost[seen], back[seen] = cost[begin] + c, begin
        path, at = [], size
        while at:
            path.append(run[back[at] : at])
            at = back[at]
        return path[::-1]

    def _words(self, script: str) -> tuple[dict[str, int], int]:
        """The list as a dictionary, and the length of its longest word."""
        if script not in self._built:
            pairs = (line.partition("\t") for line in self.lists[script].split("\n") if line)
            words = {word: int(cost or PLAIN_COST) for word, _, cost in pairs}
            self._built[script] = words, max(map(len, words), default=0)
        return self._built[script]

    def lattice(self, run: str, script: str) -> list[str]:
        """The cheapest path through the lattice of dictionary words over ``run``; other letters stand alone and cost more."""
        if script != "cjk":
            return self._by_automaton(run, script)
        # Asked for at few places: the large list isn't worth an automaton.
        words, longest = self._words(script)
        n = len(run)
        cost, back = [0] + [1 << 60] * n, [0] * (n + 1)
        for i in range(n):
            base = cost[i]
            if base + UNKNOWN_COST < cost[i + 1]:
                cost[i + 1], back[i + 1] = base + UNKNOWN_COST, i
            for j in range(i + 1, min(n, i + longest) + 1):
                c = words.get(run[i:j])
                if c is not None and base + c < cost[j]:
                    cost[j], back[j] = base + c, i
        path = []
        while n:
            path.append(run[back[n] : n])
            n = back[n]
        return path[::-1]


def installed_lexicon(spark: SparkSession | None = None) -> Lexicon:
    return Lexicon(_installed(spark is not None))
