"""Secret scans: all rules in one deterministic automaton, one pass over the bytes of each text.

Each rule has a core, the shortest thing that shows where a match is, a full form and a least length. The search automaton
(subset construction, minimised, as one transition array) runs over every byte and stops where some core
ends. A private key's form goes on over its body, to the end mark or as far as the body goes. The reversed core then gives where it began and the full form how far it goes, so spans are those of
a leftmost, longest, non-overlapping search for each kind.

Row-local: one narrow Arrow pass, memory bounded by a slice of a batch plus the largest text.

Defined cases: null and empty texts have no spans and zero counts; spans are in code points, end exclusive;
kinds are independent, so spans of different kinds may overlap; input columns other than id and text stay
in ``redact`` and are dropped in ``find_secrets``.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gistra.llm.automata import Node, alt, cls, compile_dfa, opt, reverse, seq, star, text, times
from gistra.llm.text import column, slices, utf8


class Rule(NamedTuple):
    kind: str
    core: Node
    full: Node
    #: least length from the core's last byte on, that byte included; shorter matches are dropped
    tail: int = 0
    #: lines: the full form is held against the text with a line end after it, and blanks at its end don't count
    lines: bool = False


_value = cls("a-z", "A-Z", "0-9", "+/_.=-")
_quote, _space = opt(cls("\"'")), star(cls(" "))
_name = alt(*(text(w, True) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")))
_assign = seq(_name, _quote, _space, cls(":="), _space, _quote)
_upper, _hex, _word = cls("A-Z", "0-9"), cls("0-9", "a-f"), cls("a-z", "A-Z", "0-9")
_github, _slack, _dashed = seq(text("gh"), cls("pousr"), text("_")), seq(text("xox"), cls("abprs"), text("-")), cls("a-z", "A-Z", "0-9", "-")
_pem = seq(text("-----BEGIN "), star(cls("A-Z", " ")), text("PRIVATE KEY-----"))
_base64, _indent, _any = cls("a-z", "A-Z", "0-9", "+/="), star(cls(" \t")), cls(bytes(b for b in range(256) if b not in b"\r\n"))
# line ends may be escaped, as in JSON
_end = alt(text("\r\n"), cls("\r\n"), text("\\r\\n"), text("\\n"))
_line = seq(_indent, star(_base64), _indent, _end)
_field = seq(_indent, _word, star(_dashed), text(":"), star(_any), _end)
# up to the end mark: base64, blanks, line ends and header fields, whose dashes are fewer than the mark's five
_dashes = seq(*[opt(cls("-"))] * 4)
_inner = star(seq(_dashes, alt(_base64, cls(" \t\r\n\\:,.;_()@\"'"))))
_closed = seq(_inner, text("-----END "), star(cls("A-Z", " ")), text("PRIVATE KEY-----"))
# without one: as far as fields and then lines of base64 go
_open = seq(_line, star(_field), star(_line))
_run = seq(_base64, star(_base64), star(_line))
# lines joined by blanks: only long ones differ from prose
_long = seq(cls(" \t"), _indent, times(_base64, 32), star(_base64))
_joined = seq(_long, star(_long), opt(seq(cls(" "), star(_base64), cls("="))), star(_line))

RULES = [
    Rule("assign", seq(_assign, _value), seq(_assign, _value, star(_value)), 8),
    Rule("access", seq(text("AKIA"), _upper), seq(text("AKIA"), _upper, star(_upper)), 12),
    Rule("hex", times(_hex, 32), seq(times(_hex, 32), star(_hex))),
    Rule("github", seq(_github, _word), seq(_github, _word, star(_word)), 36),
    Rule("slack", seq(_slack, _dashed), seq(_slack, _dashed, star(_dashed)), 10),
    Rule("pem", _pem, seq(_pem, opt(alt(_closed, _open, _run, _joined))), lines=True),
]
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        self.rules = rules
        self.search = compile_dfa([r.core for r in rules], True)
        self.back = [compile_dfa([reverse(r.core)], False) for r in rules]
        self.full = [compile_dfa([r.full], False) for r in rules]

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes."""
        out, past = [], [0] * len(self.rules)
        table, accepting, accepts = self.search.table, self.search.accepting, self.search.accepts
        s = 0
        for i, b in enumerate(data):
            s = table[s + b]
            if s >= accepting:
                for k in accepts[s >> 8]:
                    if i < past[k]:
                        continue
                    start = i + 1 - self.back[k].longest(data, i, -1, -1)
                    if start < past[k]:
                        continue
                    end = past[k] = self._end(k, data, start)
                    if end - i >= self.rules[k].tail:
                        out.append((start, k, end))
        return sorted(out)

    def _end(self, k: int, data: bytes, start: int) -> int:
        if not self.rules[k].lines:
            return start + self.full[k].longest(data, start, len(data))
        length = self.full[k].longest(data + b"\n", start, len(data) + 1)
        return start + len(data[start : start + length].rstrip())

    def spans(self, data: bytes) -> list[tuple[int, str, int]]:
        """(start, kind, end) in code points of the UTF-8 text."""
        found = self.byte_spans(data)
        if not found or data.isascii():
            return [(a, self.rules[k].kind, b) for a, k, b in found]
        # code points before each byte, in one pass: all but continuation bytes begin one
        before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        return [(int(before[a]), self.rules[k].kind, int(before[b])) for a, k, b in found]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, a digest of the base spans and all spans of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for part in slices(batch, text_col):
                every = [scanner.spans(x) for x in utf8(part, text_col)]
                base = [[s for s in spans if s[1] in BASE] for spans in every]
                counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in BASE]
                sha = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
                yield pa.RecordBatch.from_arrays([column(part, id_col), *counts, pa.array(sha, pa.string()), pa.array(map(joined, every), pa.string())], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` (overlapping spans by one mark); null stays null."""

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for part in slices(batch, text_col):
                out = []
                for x in column(part, text_col).cast(pa.binary()).to_pylist():
                    pieces, past = [], 0
                    for a, _, b in scanner.byte_spans(x or b""):
                        if a >= past:
                            pieces += [x[past:a], mark.encode()]
                        past = max(past, b)
                    out.append(b"".join([*pieces, x[past:]]) if pieces else x)
                k = part.schema.get_field_index(text_col)
                yield part.set_column(k, part.schema.field(k), pa.array(out, pa.binary()).cast(part.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
