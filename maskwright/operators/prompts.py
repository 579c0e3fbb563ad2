"""Model detection in turn: the prompt of a chunk lists what the chunks before it gave.

The chunks of a document are read in order by one task, which carries the entries
found so far; documents are independent of each other, so the result doesn't depend on
how they are dealt.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.answers import ITEMS
from maskwright.functions.tags import HELP, TAGS, allowed_tags
from maskwright.operators.detect import _model_hits, _scan

# Fixed value: the entries that a prompt lists.
LISTED = 40

_TASK = """Find private values in the text between the lines of dashes.
Answer with a JSON array alone, one object for each different value:
  {"text": the value exactly as it stands, "type": one of the tags below}
Add "linked_to" with the text of a known entry if the value belongs to it, as an address belongs to its owner.
Amounts of money, counts, percentages, years and column headings are not private; a number is private only if it
names a person or an account, or is one person's grade. Make nothing up. Without private values answer [].
"""


def entry_line(tag: str, value: str) -> str:
    return f"  {tag}: {value}"


def prompt_text(chunk: str, tags: Iterable[str] = TAGS, entries: Iterable[tuple[str, str]] = (), earlier: int = 0) -> str:
    """The question about a chunk: the task, the table of tags, the known entries (tag, value), the text.

    ``earlier`` entries aren't listed, only counted.
    """
    table = "\n".join(f"  {t}: {HELP[t]}" for t in tags)
    listed = "\n".join(entry_line(*e) for e in entries) or "  none"
    more = f"\n  and {earlier} earlier ones" if earlier else ""
    return f"{_TASK}\nTags:\n{table}\n\nKnown entries, the last ones found:\n{listed}{more}\n\n----\n{chunk}\n----\n"


TURNS = "chunk_no int, known int, listed array<string>, items " + ITEMS
_ITEM = pa.struct([("text", pa.string()), ("type", pa.string()), ("linked_to", pa.string())])


def turns(chunks: DataFrame, model: Callable[[str, str], list[dict] | None], tags: Iterable[str] = TAGS, attempts: int = 3, wait: float = 1.0, most: int = LISTED) -> DataFrame:
    """What each chunk (doc_id, chunk_no, text) was asked with, and what it gave.

    Gives doc_id, chunk_no, ``known`` (the entries found before it), ``listed`` (the last
    ``most`` of them, as lines) and ``items``.  ``model`` gets a prompt and the text it is
    about; retries, halves and failures are those of ``detect_model``.  An entry is a value
    of an allowed tag, in the order of first sight.  A task holds one document's entries
    and one chunk at a time.
    """
    allowed = allowed_tags(tags)
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, entries = object(), OrderedDict()
        for batch in batches:
            out = []
            for doc_id, no, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "chunk_no", "text")), strict=True):
                if doc_id != current:
                    current, entries = doc_id, OrderedDict()
                last = [(tag, value) for value, tag in list(entries.items())[-most:]]
                earlier = len(entries) - len(last)
                ask = lambda part: model(prompt_text(part, allowed, last, earlier), part)  # noqa: B023, E731
                items = _scan(text or "", ask, attempts, wait)
                if items is None:
                    raise RuntimeError(f"chunk {no} can't be scanned")
                out.append((no, len(entries), [entry_line(*e) for e in last], [{"text": str(i.get("text", "")).strip(), "type": str(i.get("type", "")).upper(), "linked_to": i.get("linked_to")} for i in items]))
                for i in out[-1][3]:
                    if i["text"] and i["type"] in allowed:
                        entries.setdefault(i["text"], i["type"])
            no, known, listed, items = list(zip(*out, strict=True)) or [[]] * 4
            columns = [batch.column("doc_id"), pa.array(no, pa.int32()), pa.array(known, pa.int32()), pa.array(listed, pa.list_(pa.string())), pa.array(items, pa.list_(_ITEM))]
            yield pa.record_batch(columns, names=["doc_id", "chunk_no", "known", "listed", "items"])

    ordered = chunks.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), "text").repartition("doc_id").sortWithinPartitions("doc_id", "chunk_no")
    return ordered.mapInArrow(run, f"doc_id {kind}, {TURNS}")


def detect_in_turn(chunks: DataFrame, model: Callable[[str, str], list[dict] | None], tags: Iterable[str] = TAGS, **how) -> DataFrame:
    """As ``detect.detect_model``, each chunk asked with the entries of those before it: doc_id, value, tag, source, seq, linked_to."""
    each = turns(chunks, model, tags, **how).select("doc_id", "chunk_no", F.posexplode("items").alias("k", "i"))
    return _model_hits(each.select("doc_id", "chunk_no", "k", F.col("i.text").alias("value"), F.col("i.type").alias("tag"), F.col("i.linked_to").alias("linked_to")), allowed_tags(tags))

