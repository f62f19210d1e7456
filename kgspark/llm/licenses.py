"""License scans: template-markup matching with token automata, beside exact phrase places.

A template is wording with two kinds of markup: ``[[ ... ]]`` may be absent, ``{{name|first:last}}`` stands for
``first`` to ``last`` words of any kind. It is compiled into an automaton over word tokens that accepts a run of
words only if all mandatory wording matches exactly. Templates are whole licences and notices (``license_texts``) and
short forms that name a licence. Automata start around places of a few of a template's fixed words, so that documents
without any are left after one look.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm import license_texts as whole
from kgspark.llm.common import read_table, text_blocks

#: Phrases whose every place counts, and their labels.
PHRASES = ((b"mit license", b"mit"), (b"apache license", b"apache"), (b"general public license", b"gpl"))

#: Label -> templates.
TEMPLATES = {
    "mit": (whole.MIT, "[[this {{what|0:3}} is]] {{verb|1:1}} under the [[terms of the]] mit license", "spdx license identifier mit"),
    "apache": (
        whole.APACHE,
        whole.APACHE_NOTICE,
        "{{verb|1:1}} under the [[terms of the]] apache license [[version 2 0]]",
        "spdx license identifier apache 2 0",
    ),
    "gpl": (
        whole.GPL_NOTICE,
        "licensed under the [[terms of the]] [[gnu]] general public license [[version {{n|1:2}}]]",
        "spdx license identifier gpl {{n|1:2}} [[0]] [[only]] [[or later]]",
    ),
    "lgpl": ("under the [[terms of the]] gnu lesser general public license", "spdx license identifier lgpl {{n|1:2}}"),
    "agpl": ("under the [[terms of the]] gnu affero general public license", "spdx license identifier agpl {{n|1:2}}"),
    "cc-by-nc": ("licensed under [[a]] [[the]] cc by nc [[{{n|1:2}}]]", "creative commons attribution noncommercial"),
    "cc-by": ("licensed under [[a]] [[the]] cc by {{n|1:1}} 0", "creative commons attribution {{n|1:1}} 0 international"),
    "bsd-2-clause": (whole.BSD_2, "spdx license identifier bsd 2 clause"),
    "bsd-3-clause": (whole.BSD_3, "spdx license identifier bsd 3 clause"),
    "bsd": ("{{verb|1:1}} under the bsd [[{{n|1:1}} clause]] license",),
    "mpl": (whole.MPL_NOTICE, "spdx license identifier mpl 2 0"),
    "isc": (whole.ISC, "spdx license identifier isc"),
    "zlib": (whole.ZLIB, "spdx license identifier zlib"),
    "unlicense": (whole.UNLICENSE, "spdx license identifier unlicense"),
}

ANY = None
LOOK = 8
#: A-Z become small; ASCII that isn't a letter or digit ends a word; every byte from 0x80 on belongs to a word.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


@dataclass
class Automaton:
    """Epsilon-free automaton: state -> [(word or ANY, next state)]; ``final`` states accept."""

    label: str
    moves: list[list[tuple[bytes | None, int]]] = field(default_factory=list)
    start: frozenset[int] = frozenset()
    final: set[int] = field(default_factory=set)
    anchor: list[bytes] = field(default_factory=list)  # up to ``LOOK`` mandatory words around the longest one
    probe: int = 0  # the longest one's place among them
    back: tuple[int, int] = (0, 0)  # least and most words before the anchor

    def match(self, words: list[bytes], at: int) -> int:
        """Length of the longest accepted run of words that starts at ``at``; 0 if none."""
        states, best, i = self.start, 0, at
        while states:
            if states & self.final:
                best = i - at
            if i == len(words):
                break
            states = frozenset(n for s in states for w, n in self.moves[s] if w is ANY or w == words[i])
            i += 1
        return best


def compile_template(label: str, template: str) -> Automaton:
    """Token automaton of a template. Its anchor lies in the longest run of mandatory words."""
    tokens = []
    for t in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+", template):
        tokens += [t] if t[0] in "[]{" else [w.decode() for w in words_of(t.encode())]
    edges: list[list[tuple[bytes | None, int]]] = [[]]
    eps: list[set[int]] = [set()]

    def state() -> int:
        edges.append([])
        eps.append(set())
        return len(edges) - 1

    at, opened, runs, least, most = 0, [], [[]], 0, 0
    before: list[tuple[int, int]] = [(0, 0)]
    for t in tokens:
        if t == "[[":
            opened.append((at, least))
            runs.append([])
            before.append((0, 0))
        elif t == "]]":
            first, least_before = opened.pop()
            eps[first].add(at)
            least = least_before
            runs.append([])
            before.append((least, most))
        elif t.startswith("{{"):
            low, high = map(int, t[2:-2].split("|")[1].split(":"))
            for k in range(high):
                nxt = state()
                edges[at].append((ANY, nxt))
                if k >= low:
                    eps[at].add(nxt)
                at = nxt
            least, most = least + low, most + high
            runs.append([])
            before.append((least, most))
        else:
            nxt = state()
            edges[at].append((t.encode(), nxt))
            at = nxt
            if not opened:
                runs[-1].append(t.encode())
            least, most = least + 1, most + 1
    reach = []
    for s in range(len(edges)):
        seen, todo = {s}, [s]
        while todo:
            new = eps[todo.pop()] - seen
            seen |= new
            todo += new
        reach.append(seen)
    auto = Automaton(label, [[(w, n) for r in reach[s] for w, n in edges[r]] for s in range(len(edges))], frozenset({0}))
    auto.final = {s for s in range(len(edges)) if at in reach[s]}
    run, (low, high) = max(zip(runs, before), key=lambda x: len(x[0]))
    longest = max(range(len(run)), key=lambda k: len(run[k]))
    lo = max(0, longest - LOOK // 2)
    auto.anchor, auto.probe, auto.back = run[lo : lo + LOOK], longest - lo, (low + lo, high + lo)
    return auto


def compile_all(templates: dict[str, tuple[str, ...]]) -> list[Automaton]:
    return [compile_template(label, t) for label, ts in templates.items() for t in ts]


def places(words: list[bytes], index: dict[bytes, list[int]], phrase: list[bytes], probe: int) -> list[int]:
    """Where the words of ``phrase`` stand consecutively; ``index`` has all places of its word number ``probe``."""
    n = len(phrase)
    return [i - probe for i in index.get(phrase[probe], ()) if i >= probe and words[i - probe : i - probe + n] == phrase]


@dataclass
class Scanner:
    automata: list[Automaton]

    def __post_init__(self) -> None:
        base = [(p.split(), label.decode()) for p, label in PHRASES]
        self.base = [(p, max(range(len(p)), key=lambda k: len(p[k])), label) for p, label in base]
        self.probes = {a.anchor[a.probe] for a in self.automata} | {p[k] for p, k, _ in self.base}
        self.any = re.compile(b"|".join(map(re.escape, sorted(self.probes))))

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """(number of words, phrase places with labels, template matches as (first word, words, label)).

        A place of a template counts once: with its longest match, the earliest of those.
        """
        flat = raw.translate(_TABLE)
        words = flat.split()
        if not self.any.search(flat):
            return len(words), [], []
        index: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.probes:
                index.setdefault(w, []).append(i)
        base = [(i, label) for phrase, probe, label in self.base for i in places(words, index, phrase, probe)]
        found: set[tuple[int, int, str]] = set()
        for a in self.automata:
            for i in places(words, index, a.anchor, a.probe):
                runs = [(at, a.match(words, at)) for at in range(max(0, i - a.back[1]), i - a.back[0] + 1)]
                # the run must reach over the anchor that it was looked up by
                runs = [(n, -at) for at, n in runs if n >= i - at + len(a.anchor)]
                if runs:
                    n, at = max(runs)
                    found.add((-at, n, a.label))
        return len(words), base, sorted(found)


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long"


def scan_documents(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Phrase places, labels and template matches of each document.

    ``score``: share of the labels that a template confirms (0 without labels). ``n_templates``: matches, each place of a
    template once. A null text is empty: no words, no labels (empty strings), null first_word and last_word. Texts of any
    length are scanned whole. Repeated rows are scanned each; other columns are ignored; an empty table gives no rows.
    """
    templates = templates or TEMPLATES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(compile_all(templates))
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.int64()]
        for batch in batches:
            for b in text_blocks(batch, "text", 1 << 24):
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                    n, base, found = scanner.scan(text.as_py() or b"")
                    at, own, more = [i for i, _ in base], {x for _, x in base}, {x for _, _, x in found}
                    both = own | more
                    score = len(more) / len(both) if both else 0.0
                    rows.append((doc_id, n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(both)), score, len(found)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(scan, COLUMNS)


def license_spans(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, first_word, n_words, label) of each template match: what the automata accepted, and where."""
    templates = templates or TEMPLATES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(compile_all(templates))
        for b in batches:
            rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for m in scanner.scan(t.as_py() or b"")[2]]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "first_word", "n_words", "label"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, first_word long, n_words long, label string")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_documents(read_table(spark, sf_dir, "documents"))
