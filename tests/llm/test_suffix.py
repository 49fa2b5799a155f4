import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import suffix


def brute(data):
    return sorted(range(len(data)), key=lambda i: data[i:])


@settings(max_examples=200, deadline=None)
@given(data=st.binary(max_size=60) | st.lists(st.sampled_from([0, 1]), max_size=80).map(bytes))
def test_array_and_prefixes(data):
    text = np.frombuffer(data, np.uint8)
    sa, _ = suffix.suffix_array(text)
    assert sa.tolist() == brute(data)
    lcp = suffix.kasai(text, sa, suffix.ranks(sa), 1000, lanes=3)
    for i in range(1, len(sa)):
        a, b = data[sa[i - 1] :], data[sa[i] :]
        assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    ints = text.astype(np.int32)
    sb, _ = suffix.suffix_array(ints)
    assert sb.tolist() == brute(data)
    if len(data):
        assert suffix.kasai(ints, sb, suffix.ranks(sb), 1000, lanes=3).tolist() == lcp.tolist()
    q = np.zeros((3, 4), np.int64)
    q[1, :2] = [0, 1]
    lo, hi = suffix.search(ints, sb, q, np.array([2, 2, 4]))
    for k, pat in enumerate((b"\0\0", b"\0\1", b"\0\0\0\0")):
        assert hi[k] - lo[k] == sum(data[i : i + len(pat)] == pat for i in range(len(data)))
