"""Many phrases in many texts: each text is read once by an Aho-Corasick automaton.

The phrases are dealt into shards of a checked size. A shard travels to the workers, which build its automaton (a trie
with failure links) once; texts stay where they are and get a flag.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

#: Bytes of phrases in one automaton, and in all that travel; a larger table is joined instead.
SHARD_BYTES = 8 << 20
TRAVEL_BYTES = 64 << 20

_built: dict[str, object] = {}


def _automaton(name: str, phrases: list[str]) -> object:
    if name not in _built:
        if len(_built) > 16:
            _built.clear()
        made = ahocorasick.Automaton()
        for phrase in phrases:
            made.add_word(phrase, True)
        made.make_automaton()
        _built[name] = made
    return _built[name]


def shards(table: DataFrame) -> int:
    """Automata that a table of phrases takes; 0 if they are too many to travel."""
    size = table.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    return -(-size // SHARD_BYTES) if ahocorasick is not None and size <= TRAVEL_BYTES else 0


def holds_any(text: Column, table: DataFrame, shard: int, of: int) -> Column:
    """True where a text holds a phrase of the shard."""
    held = table.filter(F.pmod(F.xxhash64("phrase"), F.lit(of)) == shard).select("phrase").toArrow().column(0).to_pylist()
    if not held:
        return F.lit(False)
    shared, name = table.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        automaton = _automaton(name, shared.value)
        return pa.array([t is not None and next(automaton.iter(t), None) is not None for t in texts.to_pylist()], pa.bool_())

    return found(text)
