"""Which texts go to the tokenizers library, and what asking costs."""

import sys
import time
import unicodedata

from millrace.llm import tokenizers_io


def test_unassigned_code_points_are_found_wherever_they_stand():
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    odd = [c for c in points if unicodedata.category(chr(c)) == "Cn"]
    assert all(tokenizers_io.has_unassigned(f"café {chr(c)}") for c in odd[::997])
    assert not tokenizers_io.has_unassigned("".join(chr(c) for c in points if unicodedata.category(chr(c)) != "Cn"))
    assert not tokenizers_io.has_unassigned("") and not tokenizers_io.has_unassigned("plain") and not tokenizers_io.has_unassigned("\ud800")


def test_asking_costs_little_beside_the_tokens():
    text = "naïve café \U0001f600 漢字 and plain words " * 50_000
    tokenizers_io.has_unassigned(text)
    began = time.process_time()
    assert not tokenizers_io.has_unassigned(text)
    assert time.process_time() - began < 0.1 * len(text) / 1e6
