import numpy as np
import pytest
from marketlens.llm.suffixes import common_prefixes, suffix_array


@pytest.mark.parametrize("text", [b"", b"a", b"aaaaaaaaaaaaaaaaaaaa", b"abracadabra" * 7, bytes(range(256)) * 3])
def test_orders_suffixes_and_counts_shared_symbols(text):
    symbols = np.frombuffer(text, np.uint8)
    order = suffix_array(symbols)
    expected = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == expected

    def shared(a, b):
        n = 0
        while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        return n

    found = common_prefixes(symbols, order, lane=8)
    assert found.tolist() == [
        shared(expected[i - 1], expected[i]) if i else 0 for i in range(len(text))
    ]


def test_random_symbols():
    symbols = np.random.default_rng(1).integers(0, 3, 3000)
    order = suffix_array(symbols)
    as_list = symbols.tolist()
    assert order.tolist() == sorted(range(3000), key=lambda i: as_list[i:])
    shared = common_prefixes(symbols, order)
    for slot in range(1, 3000, 97):
        a, b = order[slot - 1], order[slot]
        n = shared[slot]
        assert as_list[a : a + n] == as_list[b : b + n]
        assert as_list[a + n : a + n + 1] != as_list[b + n : b + n + 1]
