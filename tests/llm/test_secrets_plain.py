"""The lexer on generated source and configuration texts, whose name-literal pairs are known."""

import random
import string
import time

from docloom.llm import secrets as S

NAMES = ["db_password", "apiToken", "color", "signing_secret", "width", "user_name", "SECRET_KEY", "publicKey", "title", "authCookie"]


def value(rng):
    if rng.random() < 0.3:
        return rng.choice(["changeme", "your_key_here", "shortie", "plain words here", "aaaaaaaaaaaa"])
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(10, 30)))


def statement(rng, name, v):
    """(text of a binding, places of the value's parts in it)."""
    q = rng.choice("\"'")
    k = rng.randrange(9)
    if k == 0:
        cut = rng.randint(1, len(v) - 1)
        t = f"{name} = {q}{v[:cut]}{q} + {q}{v[cut:]}{q}"
        a = len(name) + 4
        return t, [(a, a + cut), (a + cut + 5, a + cut + 5 + len(v) - cut)]
    if k == 1:
        t = f"{name}: |\n  {v}\nend_of_block: 1"
        return t, [(t.index(v), t.index(v) + len(v))]
    head, tail = [(f"{name} = {q}", q), (f'{{"{name}": {q}', q + "}"), (f"{name} := {q}", q), (f"config[{q}{name}{q}] = {q}", q), (f"set_{name}({q}", q + ")"), (f'{name} = """', '"""'), (f"<{name}>", f"</{name}>")][k - 2]
    if head.startswith("<") and " " in v:
        head, tail = f"{name} = {q}", q
    return head + v + tail, [(len(head), len(head) + len(v))]


def test_pairs_of_generated_texts():
    rng = random.Random(21)
    hits = 0
    for _ in range(400):
        text, wanted, weights, places = "", set(), {}, {}
        for i in range(rng.randint(1, 6)):
            name, v = rng.choice(NAMES) + str(i), value(rng)
            line, spans = statement(rng, name, v)
            key = f"set_{name}" if f"set_{name}(" in line else name
            weights[name], places[name] = S.name_weight(key), ([(len(text) + a, len(text) + b) for a, b in spans], v)
            text += line + "\n"
        for name in list(weights):  # constants that are passed on
            if rng.random() < 0.4 and f"set_{name}(" not in text:
                other = rng.choice(NAMES) + "_" + str(rng.randrange(100, 999))
                weights[name] = max(weights[name], S.name_weight(other))
                text += f"{other} = {name}\n"
        for name, (spans, v) in places.items():
            if weights[name] > 0 and weights[name] + S.literal_weight(v) >= S.THRESHOLD:
                wanted.update((a, b, "literal") for a, b in spans)
        got = {s for s in S.literal_spans(text) if text[s[0] : s[1]] not in weights}
        assert got == wanted, text
        hits += len(wanted)
    assert hits > 300


def found(text):
    return [text[a:b] for a, b, _ in S.literal_spans(text)]


K = "Zk39dPq0LmT7vB2x"


def test_names_and_types_of_any_length():
    assert found("x" * 500 + f'_secret_key = "{K}"') == [K]
    assert found(f'const signingSecret: Map<string, {"Abcdefgh, " * 30} int> = "{K}"') == [K]
    assert found("--" + "a-" * 200 + f"password {K}") == [K]


def test_blocks_subscripts_later_constants_and_calls():
    assert found(f"private_secret_key: |\n  {K}\n  AbCd{K}\nnext: 1\n") == [K, "AbCd" + K]
    assert found(f'tokens:\n  - {K}\n  - "b{K}"\nx: 1') == [K, "b" + K]
    assert found(f"os.environ['SECRET_KEY'] = '{K}'\nsecret_keys[0] = \"c{K}\"") == [K, "c" + K]
    assert found(f'api_token = X\ncolor = Y\nX = "{K}"\nY = "b{K}"') == [K]
    assert found(f'setdefault("SECRET_KEY", "{K}")\nset_password("b{K}")\nprint("c{K}")') == [K, "b" + K]
    assert found('password = "Xk9q" + "7Zp2" + "LmQ8"') == ["Xk9q", "7Zp2", "LmQ8"]
    assert found('password = (\n  "Zk39dPq0"\n  "LmT7vB2x")') == ["Zk39dPq0", "LmT7vB2x"]
    assert found('secret = """' + K + '"""') == [K]
    assert found("a = b\nb = a\nsecret = a") == []


def test_aliases_and_blocks_take_linear_time():
    def chain(n):
        return 'k = "' + '" + "'.join(["abc"] * (n // 14)) + '"\n' + "".join(f"n{i} = {f'n{i - 1}' if i else 'k'}\n" for i in range(n // 28))

    for make in (chain, lambda n: "a: |\n" + " b\n" * (n // 3), lambda n: "x: |\n" * (n // 5), lambda n: "tokens:\n" + "  - abc\n" * (n // 8), lambda n: "a: " + "b c " * (n // 4)):
        times = []
        for n in (200_000, 400_000):
            text, began = make(n), time.process_time()
            S.literal_spans(text)
            times.append(time.process_time() - began)
        assert times[1] < 2.6 * times[0] + 0.3
