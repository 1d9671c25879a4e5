"""Plain Python versions of what the queries return, and small documents with every edge."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=None):
    rng = random.Random(seed)
    vocabulary = words or [f"{a}{b}" for a in ("ta", "no", "ri", "sel", "mu", "éka") for b in ("ra", "lin", "do", "pes", "ñu", "kor")]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows(texts, source=lambda i: f"s{i % 3}"):
    return [(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)]


def edge_texts():
    base = prose(1, 300)
    return [
        None, "", " \n\t ", "one", "two words", base, base, base + " more", base.replace("ta", "to", 1), prose(2, 40), "same " * 500, "x" * 5000,
        "Line one of a text.\nLine one of a text.\n" + prose(3, 30), prose(4, 3000), "İstanbul ΣΑΣ é́ 你好 <|endoftext|> it's",
    ]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def fingerprint(text):
    import xxhash

    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, linked):
    """item -> least item reachable, by all pairs."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in items}


def first_of_near_copies(pairs):
    """Of each group of texts linked by a similarity of 0.8 of five-word shingles, the text with the smallest id, ids last
    that are null; as a Counter of (id, text)."""
    least = {}
    for i, t in pairs:
        key = (i is None, i if i is not None else 0)
        least[t or ""] = min(key, least.get(t or "", (True, 1)))
    sets = {}
    for t in least:
        words = WORD.findall(lower(t))
        sets[t] = {tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))} if words else set()
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    groups = defaultdict(list)
    for t, root in components(sorted(least), similar).items():
        groups[root].append((least[t], t))
    first = []
    for members in groups.values():
        key, t = min(members)
        tied = [x for k, x in members if k == key]
        first.append((None if key[0] else key[1], t if len(tied) == 1 else None))
    return Counter(first)


def repeats(pairs, threshold):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each (doc_id, text)."""
    data = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter(b[s : s + threshold] for _, b in data for s in range(len(b) - threshold + 1))
    out = []
    for i, b in data:
        covered = bytearray(len(b))
        for s in range(len(b) - threshold + 1):
            if seen[b[s : s + threshold]] > 1:
                covered[s : s + threshold] = b"\1" * threshold
        runs = sum(1 for k, c in enumerate(covered) if c and not (k and covered[k - 1]))
        out.append((i, len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return sorted(out, key=repr)


def check_pieces(pieces, ids_of, capacity=2048, copies=None):
    """Every id of every document lies in exactly one piece, sequences are gapless and not too long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc_id, ids in ids_of.items():
        own = sorted(by_doc.pop(doc_id), key=lambda p: p["start"])
        times = (copies or {}).get(doc_id, 1)
        assert sum(p["length"] for p in own) == times * len(ids) // 4
        for p in own:
            assert p["doc_tokens"] == len(ids) // 4
            assert p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])
        assert Counter(i for p in own for i in range(p["start"], p["start"] + p["length"])) == {i: times for i in range(len(ids) // 4)}
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return by_sequence


class Feistel:
    """The permutations of the pseudonyms, in plain Python."""

    def __init__(self, key):
        self.key = key

    def digest(self, *parts):
        return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()

    def number(self, value, a, b, tag):
        left, right = divmod(value, b)
        for i in range(8):
            if i % 2 == 0:
                left = (left + int(self.digest(self.key, tag, i, right)[:15], 16) % a) % a
            else:
                right = (right + int(self.digest(self.key, tag, i, left)[:15], 16) % b) % b
        return left * b + right

    def digits(self, digits, tag):
        n = len(digits)
        return str(self.number(int(digits), 10 ** (n // 2), 10 ** (n - n // 2), tag)).zfill(n)

    def text(self, text, tag, plain=False):
        classes = ["0123456789abcdef"] if re.fullmatch("[0-9a-f]+", text) and not plain else ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ"]

        def moved(part, seed):
            out = []
            for i, c in enumerate(part):
                alphabet = next((x for x in classes if c in x), None)
                byte = int(self.digest(seed, i // 32)[i % 32 * 2 :][:2], 16)
                out.append(c if alphabet is None else alphabet[(alphabet.index(c) + byte) % len(alphabet)])
            return "".join(out)

        left, right = text[: len(text) // 2], text[len(text) // 2 :]
        for i in range(8):
            if i % 2 == 0:
                left = moved(left, self.digest(self.key, tag, len(text), i, right))
            else:
                right = moved(right, self.digest(self.key, tag, len(text), i, left))
        return left + right

    def ip(self, value):
        number = 0
        for x in value.split("."):
            number = number * 256 + int(x)
        number = self.number(number, 65536, 65536, "ip")
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))

    def ssn(self, value):
        area, group, serial = map(int, value.split("-"))
        number = self.number(((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
        area, group, serial = number // (99 * 9999), number // 9999 % 99 + 1, number % 9999 + 1
        return f"{area + (2 if area >= 665 else 1):03}-{group:02}-{serial:04}"

    def card(self, value):
        payload = value[0] + self.digits(value[1:-1], "card")
        return next(payload + d for d in "0123456789" if luhn(payload + d))

    def email(self, value):
        head, dot, end = value.rpartition(".")
        return self.text(head, "email") + dot + end

    def iban(self, value):
        own = self.text(value[4:], "iban", plain=True)
        check = 98 - int("".join(str(int(c, 36)) for c in own + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02}{own}"


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def python_workers(df) -> int:
    """The most Python workers that a task of df has at a time: nodes in Python with no exchange between them."""

    def walk(node) -> tuple[int, int]:  # of the tasks that this node is in, and of any below
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        children = [walk(node.children().apply(i)) for i in range(node.children().size())]
        own, below = max((x for x, _ in children), default=0), max((x for _, x in children), default=0)
        if name in ("Exchange", "BroadcastExchange"):
            return 0, max(own, below)
        return own + name.endswith(("InPandas", "InArrow", "EvalPython")), below

    return max(walk(df._jdf.queryExecution().executedPlan()))


def join_rows(spark, run) -> int:
    """The most rows that one join makes while run() runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    before, most = ids(), 0
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for i in ids() - before:
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most
