"""What a worker process holds of the parts that it has coded."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest

from floodgauge.llm import parts
from tests.conftest import ROOT

#: The function that packing runs over blocks, on four blocks of new words; prints the MB that remain.
HELD = """
import random, re
from pathlib import Path
import pyarrow as pa
import public_tokenizers
from floodgauge.llm import packing

class Docs:
    def select(self, *names):
        return self

def held():
    return sum(map(int, re.findall(r"\\n(?:Private_Dirty|Private_Clean):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

packing.map_blocks = lambda docs, function, *rest, **more: function
block = packing.token_pieces(Docs(), public_tokenizers.path("byte_bpe_50k.json"))
rng = random.Random(3)
text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n))
block({"doc_id": [0], "text": pa.array([text(1000)])})
before = held()
for i in range(4):
    block({"doc_id": list(range(100)), "text": pa.array([text(1400) for _ in range(100)])})
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_worker_holds_little_of_the_coded_parts():
    env = os.environ | {"PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])}
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, env=env, check=True)
    assert float(out.stdout) < 95, out.stdout


@pytest.mark.parametrize("capacity", [0, 3, 1000])
def test_known_parts(capacity):
    """The ids of every word, whichever generation they come from; long words are not kept."""
    known, asked = parts.KnownParts(capacity), []

    def learn(words):
        asked.extend(words)
        return [w.encode("utf-32-le") for w in words]

    long = "x" * (parts.CACHED_CHARS + 1)
    for words in (["a", "bc"], ["bc", "", "é"], [], [long, "a"], ["a", "d", long, "bc"], ["é", "e", "f"], ["a"]):
        values, bounds = known.rows(pa.array(words, pa.string()), learn)
        assert ["".join(map(chr, values[a:b])) for a, b in zip(bounds, bounds[1:])] == words
        assert long not in known.young[0].to_pylist()
    assert asked.count(long) == 2
    if capacity == 1000:
        assert sorted(asked) == sorted(["a", "bc", "", "é", long, long, "d", "e", "f"])
