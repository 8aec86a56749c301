"""Parts that need no session: codecs, kernels, packing, grammars, each against a plain version."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import embedding_dedup, quality, secrets, sharding, toxicity
from tessera.llm.bpe import codec, default_vocabulary
from tessera.llm.shingles import MinMax, shingle_set, text_words, word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


TEXTS = ["", "  ", "ΑΣ ΣΑΣ", "İstanbul ſ K", "a\x1cb\x1fc\x85d e f", "<|endoftext|>a <|startoftext|>b</w> don't we'll '' 's", "ﬁ é ẛ̣ 日本語 12½²", "!!!!!?????", "x" * 5000, "ab" * 3000, "🤖🤖 \u200d\ufeff", "\x00\x01 a_b-c", "aaaaaaa" * 9]


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    packed = codec(default_vocabulary()).encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert codec(default_vocabulary()).decode(packed).decode() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_as_the_library(library, text):
    same(library, text)


def test_bpe_knows_the_letters_that_the_library_knows(library):
    """All code points, beside a letter, a digit and a sign, so that a wrong class would join or cut words."""
    for first in range(0, 0x110000, 0x400):
        same(library, " ".join(f"a{chr(c)}1{chr(c)}:{chr(c)}" for c in range(first, first + 0x400) if not 0xD800 <= c < 0xE000))


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("abcdefthe '.1é\nß"), st.characters(codec="utf-8", max_codepoint=0x2FFF)), max_size=60))
def test_bpe_as_the_library_on_any_text(library, text):
    same(library, text)


def test_word_hashes_do_not_depend_on_place_or_segment(monkeypatch):
    raw = lambda s: np.frombuffer(s.encode(), np.uint8)
    a, _ = word_hashes(raw("one two  ONE\tthree"))
    assert a[0] == a[2] and len(set(a.tolist())) == 3
    text = " ".join(f"w{i}" for i in range(5000))
    whole = text_words(raw(text))
    monkeypatch.setattr("tessera.llm.shingles.SEGMENT", 1000)
    assert (text_words(raw(text)) == whole).all()
    assert len(text_words(raw("x" * 5000 + " y"))) == 2


@given(st.lists(st.sampled_from(["a", "B", "c", "dd"]), max_size=12))
def test_shingle_sets(words):
    got = shingle_set(" ".join(words), 4)
    w = " ".join(words).translate(LOWER).split()
    n = min(4, len(w))
    assert len(got) == (len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) if w else 0)


def test_min_max_estimates():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    a, b = x[:900], x[100:]
    s = MinMax(256, 4).signatures(np.concatenate([a, b]), np.array([0, 900]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.06


def test_window_entropies():
    s = "".join(random.Random(1).choice("abc123") for _ in range(60))
    for i, bits in enumerate(secrets.window_entropies(s)):
        w = s[i : i + secrets.WINDOW]
        assert math.isclose(bits, -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)), abs_tol=1e-9)


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


@given(st.lists(st.sampled_from(["token", "SECRET", " = ", ":", '"', "abc12345", "AKIA", "ABCD1234ABCD", "0123abcd" * 4, "x", "é", "\n", "api_key"]), max_size=14).map("".join))
def test_base_secrets(text):
    assert secrets.find_spans(text)[0] == plain_spans(text)


def test_entropy_spans_and_allow_list():
    key = "q7Zr9TtX2mVb8KwLpN4cYs6D"
    base, spans = secrets.find_spans(f"é key {key} end")
    assert base == [] and spans == [(6, 3, 6 + len(key))]
    for plain in ("550e8400-e29b-41d4-a716-446655440000", "12345678901234567890123", "thisisaverylongordinaryword", "some_snake_case_name_2_of_it", "example7Zr9TtX2mVb8KwLpN4cYs", "z" * 200):
        assert secrets.find_spans(plain) == ([], [])
    assert secrets.find_spans(None) == secrets.find_spans("") == ([], [])


def test_entropy_spans_beside_placeholders():
    """A key is found beside an allowed word, at the place where it stands."""
    key = "ghp_q7Zr9TtX2mVb8KwLpN4cYs6D"
    for text in (key, f"/example/{key}", f"sampled={key}", f"{key}/dummy", f"xxxxxx-{key}==example", f"your_name/{key}"):
        at = text.index(key)
        assert secrets.find_spans(text) == ([], [(at, 3, at + len(key))]), text
    for plain in ("your_q7Zr9TtX2mVb8KwLpN4cYs6D", "/docs/example7Zr9TtX2mVb8KwLpN4cYs/a", "q7Zr9TtX/example/2mVb8KwLpN4"):
        assert secrets.find_spans(plain) == ([], [])


def plain_entropy_spans(text):
    """Entropy spans with every window counted anew, pieces judged one by one, and no incremental state."""
    covered = set()
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run, base = m.group(), m.start()
        pieces = [(p.start(), p.end()) for p in re.finditer(r"[^-_/=+]+", run)]
        bad = [(x.start(), x.end(), x.group()[-1] in "-_") for x in re.finditer(secrets._PLACEHOLDER, run)]
        alive = [True] * len(run)
        for a, b, joins in bad:
            begin = max([run.rfind(c, 0, a) + 1 for c in "-_/=+"])
            after = [i for i in range(b, len(run)) if run[i] in ("/=+" if joins else "-_/=+")]
            end = after[0] if after else len(run)
            alive[begin:end] = [False] * (end - begin)
        parts, at = [], 0
        for i in range(len(run) + 1):
            if i == len(run) or not alive[i]:
                if i > at:
                    lo, hi = at, i
                    while at > 0 and lo < hi and run[lo] in "-_/=+":
                        lo += 1
                    while i < len(run) and hi > lo and run[hi - 1] in "-_/=+":
                        hi -= 1
                    parts.append((lo, hi))
                at = i + 1
        for lo, hi in parts:
            s = run[lo:hi]
            words = all(re.fullmatch(r"[A-Za-z]+\d{0,2}|\d{1,4}", p) for p in re.split(r"[-_/=+]", s) if p)
            if words or s.isdigit() or re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s):
                continue
            least = secrets.THRESHOLDS["hex" if re.fullmatch("[0-9a-fA-F]*", s) else "alnum" if re.fullmatch("[A-Za-z0-9]*", s) else "base64"]
            for i in range(len(s) - secrets.WINDOW + 1):
                w = s[i : i + secrets.WINDOW]
                bits = -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))
                if bits >= least - 1e-9 and re.search("[0-9]", w) and re.search("[A-Za-z]", w):
                    covered |= set(range(base + lo + i, base + lo + i + secrets.WINDOW))
    return sorted(covered)


@settings(max_examples=150, deadline=500)
@given(st.lists(st.sampled_from(["q7Zr9TtX2mVb8KwLpN4cYs6D", "0f1e2d3c4b5a69788796", "example", "your_", "/", "-", "=", "_name_", "word12", "2024", " ", "xxxxxx", "Ab3dE5", "550e8400-e29b-41d4-a716-446655440000", "a1b2c3d4e5f6g7h8i9j0k"]), max_size=10).map("".join))
def test_entropy_spans_against_a_plain_version(text):
    """Every character of an entropy span is in some window that a plain search finds, and the other way round."""
    assert sorted({i for a, b in secrets.entropy_spans(text) for i in range(a, b)}) == plain_entropy_spans(text)


@settings(max_examples=60, deadline=200)
@given(st.lists(st.sampled_from("-=_/+ab9Z"), min_size=1, max_size=6).map("".join), st.integers(1, 10_000), st.sampled_from(["", "12345x", "q7Zr9TtX2mVb8KwLpN4cYs6D", "%"]))
def test_repetitive_runs_take_linear_time(unit, size, tail):
    secrets.find_spans((unit * size)[:10_000] + tail)


@pytest.mark.parametrize("text", ["-=" * 5_000 + "12345678901x", "/".join(["ab"] * 3_400) + "/12345x", "a1" * 5_000 + "-", "token" + " " * 10_000, "example" * 1_500, "_9" * 5_000 + "xx"])
def test_long_dividers_and_paths_are_quick(text):
    begun = time.perf_counter()
    secrets.find_spans(text)
    assert time.perf_counter() - begun < 0.2


def plain_best_fit(sizes, capacity):
    """Bin of each of ``sizes``, one by one, by looking at all bins."""
    bins, out = [], []
    for s in sizes:
        fit = [(r, i) for i, r in enumerate(bins) if r >= s]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append(capacity)
        bins[i] -= s
        out.append(i)
    return out


def counted(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def spread(runs):
    return [b for own in runs for b, k in own for _ in range(k)]


def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(2)
    for _ in range(80):
        sizes = sorted((rng.randint(1, rng.choice([4, 40])) for _ in range(60)), reverse=True)
        assert spread(sharding.best_fit_decreasing(counted(sizes), 50)) == plain_best_fit(sizes, 50)


def test_packing_is_near_equal_and_keeps_a_giant_alone():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 1000) for _ in range(2000)), reverse=True)
    load = np.bincount(spread(sharding.pack_into(counted(sizes), 40)), weights=sizes, minlength=40)
    assert len(load) == 40 and load.max() / load.mean() < 1.01
    for giants in ([10**6], [10**6, 10**6], [10**6 + 1, 10**6]):
        where = spread(sharding.pack_into(counted([*giants, *sizes]), 40))
        load = np.bincount(where[len(giants) :], weights=sizes, minlength=40)
        assert len(set(where[: len(giants)])) == len(giants) and not set(where[: len(giants)]) & set(where[len(giants) :]) and load[load > 0].max() / load[load > 0].mean() < 1.01
    assert sharding.pack_into([], 40) == []
    assert spread(sharding.pack_into([(5, 50)], 40)) == plain_best_fit([5] * 50, 10)
    assert sorted(spread(sharding.pack_into([(7, 3), (1, 1)], 4))) == [0, 1, 2, 3]
    for _ in range(100):
        some = sorted((rng.choice([1, 2, 3, 50, 400]) for _ in range(rng.randrange(1, 30))), reverse=True)
        where = spread(sharding.pack_into(counted(some), 5))
        assert len(where) == len(some) and set(where) <= set(range(5))


def test_grammar_weighs_clauses():
    g = toxicity.Grammar([("w", "fool", 5.0), ("p", "idi", 4.0), ("w", "idiot", 5.0)])
    plain, target = g.evidence("that is a fool.")[0], g.evidence("you are a fool.")[0]
    assert target > plain > g.evidence("he said that is a fool")[0] > g.evidence("that is not a fool")[0] > 0
    assert g.evidence("idiotic")[0] == 4.0 and g.evidence("foolish")[0] == 0.0 and g.evidence("a videofool")[0] == 0.0
    assert g.evidence("I will kill it")[0] > 0 == g.evidence("kill time")[0]
    assert g.evidence("") == g.evidence(None) == (0.0, 0.0, 0)
    assert g.evidence("fool. fool! x\nfool")[2] == 3
    assert g.evidence("a fool, you")[0] == g.evidence("you fool")[0] == 7.5 and g.evidence("a fool " + "w " * 300 + "you")[0] == 5.0
    assert g.evidence("'idiot'")[0] == g.evidence("_idiot_")[0] == g.evidence("l'idiot")[0] == 5.0


def test_grammar_reads_four_languages():
    g = toxicity.Grammar([("w", "idiot", 5.0)])
    for text in ("ich werde dich toeten", "je vais te tuer", "voy a matar a ese, usted", "I will kill you"):
        assert g.evidence(text)[0] == 1.5 * toxicity.THREAT, text
    assert g.evidence("le chef du village est un idiot")[0] == g.evidence("le chef de village est un idiot")[0] == 5.0
    assert g.evidence("du bist ein idiot und das ist so")[0] == 7.5 and g.evidence("tu es un idiot et un chef")[0] == 7.5
    assert g.evidence("ich werde dich nicht toeten")[0] == pytest.approx(1.5 * toxicity.THREAT * toxicity.NEGATED)


def paths(t, state, symbols):
    """All (symbols written, factors) of a transducer's accepted paths."""
    if not symbols:
        return [((), ())] if state in t.final else []
    return [((out, *o), (f, *fs)) for out, f, to in t.arcs[state, symbols[0]] for o, fs in paths(t, to, symbols[1:])]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["you", "not", "said", "will", "kill", "fool", "x", "moron", "going"]), max_size=9))
def test_composed_machine_against_all_paths(tokens):
    """The best path's score is the most of all paths of the five transducers run one after the other."""
    weights = {"fool": 5.0, "moron": 3.5}
    role = toxicity.roles("en")
    chains = [(tuple(role.get(t, "") + "i" * (t in weights) for t in tokens), (1.0,) * len(tokens))]
    for t in toxicity.stages("en"):
        chains = [(out, tuple(a * b for a, b in zip(f, g, strict=True))) for x, f in chains for out, g in paths(t, t.start, x)]
    score = lambda out, f: sum(k * (("I" in o) * weights.get(t, 0) + ("T" in o) * toxicity.THREAT) for t, o, k in zip(tokens, out, f, strict=True))
    want = max(score(o, f) for o, f in chains)
    # A common English word, which has no role, keeps the other languages' machines out.
    assert toxicity.clause_score([*tokens, *["w"] * 7, "the", "of", "and"], lambda t: weights.get(t, 0.0)) == pytest.approx(want)
    plain = 0.0
    for i, t in enumerate(tokens):
        mark = weights.get(t, 0) + (t == "kill" and any(x in ("will", "going") for x in tokens[max(0, i - 3) : i])) * toxicity.THREAT
        near = "you" in tokens[max(0, i - 6) : i + 7]
        mark *= (1.5 if near else 1.0) * (0.1 if "not" in tokens[max(0, i - 3) : i] else 1) * (0.4 if "said" in tokens[max(0, i - 6) : i] else 1)
        plain += mark
    assert plain == pytest.approx(want)


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**44, 5000))
    table = quality.Lookup(keys[::2], np.arange(len(keys[::2]), dtype=np.float32))
    value, found = table.get(keys)
    assert found[::2].all() and not found[1::2].any() and (value[::2] == np.arange(len(keys[::2]))).all()
    assert not quality.Lookup(keys[:0], np.zeros(0)).get(keys)[1].any()


@pytest.mark.parametrize("kind", ["even", "dense", "clusters", "opposite", "line"])
@pytest.mark.parametrize("threshold", [0.98, 0.7, -0.5])
def test_close_pairs_against_all_pairs(kind, threshold):
    rng = np.random.default_rng(6)
    n, x = 600, rng.standard_normal((600, 16))
    x = {"even": x, "dense": 0.3 * x + 3, "clusters": 0.15 * x + rng.standard_normal((5, 16))[rng.integers(0, 5, n)], "opposite": x + rng.choice([-5, 5], (n, 1)), "line": x[:, :1]}[kind]
    x, component = embedding_dedup._unit(x), rng.integers(0, n // 2, n)
    linked = (x @ x.T >= threshold) & (component[:, None] != component)
    for p, q in ((np.arange(n), np.arange(n)), (np.arange(n // 2), np.arange(n // 2, n)), (np.arange(0, n, 150), np.arange(1, n, 150))):
        found = [tuple(sorted(t)) for a, b in embedding_dedup._close_pairs(x, p, q, component, threshold) for t in zip(a.tolist(), b.tolist(), strict=True)]
        asked = np.zeros((n, n), dtype=bool)
        asked[np.ix_(p, q)] = True
        assert len(found) == len(set(found)) and set(found) == {tuple(sorted(t)) for t in np.argwhere(linked & asked).tolist()}


def test_local_roots():
    assert embedding_dedup._local_roots(6, np.array([4, 3, 1]), np.array([5, 4, 2])).tolist() == [0, 1, 1, 3, 3, 3]
