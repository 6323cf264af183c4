import random

from tenderlake.llm import bpe_codec


def ranks():
    words = [bytes([b]) for b in range(256)] + [a + b for a in (b"a", b"b", b"c") for b in (b"a", b"b", b"c")] + [b"abab", b"caca", b"bcbc"]
    return {w: i for i, w in enumerate(words)}


def test_clearing_keeps_the_oldest_of_many_states_that_were_met():
    dice = random.Random(2)
    words = [bytes(dice.choices(b"abc", k=40)) for _ in range(200)]
    small, large = bpe_codec.Transducer(ranks(), 8), bpe_codec.Transducer(ranks())
    assert [small.encode(w) for w in words] == [large.encode(w) for w in words]
    small.encode_all(words)
    assert len(small.met) > small.most // 2 and len(small.states) > small.most
    old = list(small.states)
    small.clear()
    assert 1 < len(small.states) <= small.most // 2 and set(small.states) <= set(old) and small.states[0] == (0,)
    assert [small.encode(w) for w in words] == [large.encode(w) for w in words]


def test_stretches_that_cut_characters_decode_as_bytes_do():
    dice = random.Random(3)
    machine = bpe_codec.Utf8Machine({i: w for w, i in ranks().items()})
    for size in (0, 1, 63, 64, 65, 500):
        ids = [x for _ in range(size) for x in dice.choice([[97], [260], list("é".encode()), list("😀".encode()), [0xF0, 0x9F], [0x80]])]
        want = b"".join(machine.tokens[i] for i in ids).decode("utf-8", "replace")
        for block in (1, 100, 4096):
            assert "".join(machine.decode(iter(ids), block)) == want
    assert 97 in machine.whole and 260 in machine.whole and not {0xC3, 0xF0} & set(machine.whole)
