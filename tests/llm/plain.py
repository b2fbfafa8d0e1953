"""The operators, written plainly: what they must equal on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def folded(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(docs, n=50):
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = {x for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for x in range(k, k + n)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[SPACE.sub(" ", t or "")].append(i)
    return sorted((i, min(g), len(g), i == min(g), sha(t)) for t, g in groups.items() for i in g)


def contaminated(docs, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = folded(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, names = folded(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if found := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    names |= found
        out.append((i, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return sorted(out)


def shingles(text, n):
    w = words(lower(text))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near(docs, n=3, threshold=85):
    sets = {i: shingles(t, n) for i, t in docs}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((find(a), find(b)))
                top[hi] = lo
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    """sizes: {source: size}; the excess of full sources is shared out again until none is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, full, budget = {}, set(), share * sum(sizes.values())
    while True:
        rest = budget - sum(limit * sizes[s] for s in full)
        total = sum(weight[s] for s in sizes if s not in full)
        out = {s: limit * sizes[s] if s in full else rest * weight[s] / total for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > limit * sizes[s]}
        if not over:
            return out
        full |= over


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def personal(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and (not 14 <= len(digits) <= 19 or (sum(digits[::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [f"{BASE[k][0]}:{s}:{e}" for s, k, e in sorted(out)]


def tokens(docs, path, end=2):
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(path), [], 0
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def code_length(text, counts, order=4):
    """Bits of the text's words under counts: {context bytes: Counter of bytes}."""
    total = 0.0
    for w in words(lower(text)):
        stream = b" " + w.encode() + b" "
        for k in range(1, len(stream)):
            for depth in range(min(k, order), -1, -1):
                seen = counts.get((depth, stream[k - depth : k]))
                if seen is None:
                    continue
                n, kinds = sum(seen.values()), len(seen)
                if stream[k] in seen:
                    total += math.log2(n + kinds) - math.log2(seen[stream[k]])
                    break
                total += math.log2(n + kinds) - math.log2(kinds)
            else:
                total += 8
    return total


def context_counts(texts, order=4):
    counts = defaultdict(Counter)
    for text in texts:
        for w in words(lower(text)):
            stream = b" " + w.encode() + b" "
            for k in range(1, len(stream)):
                for depth in range(min(k, order) + 1):
                    counts[depth, stream[k - depth : k]][stream[k]] += 1
    return counts


def languages(docs, order=4):
    """(doc_id, held_out, lang_pred, score) of (doc_id, text, lang), learned from all documents that aren't held out."""
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    texts = defaultdict(list)
    for i, t, lang in docs:
        if i is not None and t is not None and lang is not None and not out_of(i) and t.strip():
            texts[lang].append(t)
    trees = {lang: context_counts(texts[lang], order) for lang in sorted(texts)}
    out = []
    for i, t, _ in docs:
        if not trees or not any(c.isalpha() for c in t or ""):
            out.append((i, out_of(i), "und", 0.0))
            continue
        bits = [(code_length(t, counts, order), lang) for lang, counts in trees.items()]
        least, lang = min(bits)
        out.append((i, out_of(i), lang, 1 / sum(2.0 ** max(least - b, -1000) for b, _ in bits)))
    return out


def byte_pair_bits(texts):
    pairs, firsts = Counter(), Counter()
    for t in texts:
        raw = (t or "").encode()
        pairs.update(zip(raw, raw[1:]))
        firsts.update(raw[:-1])
    return lambda a, b: math.log2((firsts[a] + 256) / (pairs[a, b] + 1))


def secrets(text, bits):
    out = []
    for m in re.finditer("[A-Za-z0-9]{16,}", text or ""):
        raw = m[0].encode()
        total = sum(bits(a, b) for a, b in zip(raw, raw[1:]))
        rate = 4.5 if any(c.isdigit() for c in m[0]) else 6.5
        if sum(c.isalpha() for c in m[0]) >= 2 and total >= 64 and total >= rate * (len(raw) - 1):
            out.append((m.start(), m.end()))
    return out


def all_personal(texts, near=8, contexts=4, posterior=0.5, bits=5.0, diversity=0.4):
    """The spans of each text, as text, and the sanitised texts."""
    kinds = ["email", "ip", "card", "phone", "secret"]
    pair_bits, total = byte_pair_bits(texts), sum(len(folded(t)) for t in texts)
    found, words_of, close = [], [], []
    for t in texts:
        spans = [(int(x.split(":")[1]), kinds.index(x.split(":")[0]), int(x.split(":")[2])) for x in personal(t)]
        spans += [(s, 4, e) for s, e in secrets(t, pair_bits) if not any(a < e and s < b for a, _, b in spans)]
        spans.sort()
        words = [(m.start(), m.end(), m[0]) for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))]
        free = [w for w in words if not any(s < w[1] and w[0] < e for s, _, e in spans)]
        mine = []
        for s, _, e in spans:
            a, b = sum(w[0] < s for w in free), sum(w[0] < e for w in free)
            mine.append(free[max(0, a - near) : b + near])
        found.append(spans)
        words_of.append(free)
        close.append(mine)
    mentions, n, sets = Counter(), Counter(), defaultdict(dict)
    for t, spans, mine in zip(texts, found, close):
        for (s, k, e), window in zip(spans, mine):
            terms = {w for _, _, w in window if len(w.encode()) >= 3}
            raw = t[s:e]
            entity = (k, raw.lower() if k < 2 else raw if k == 4 else re.sub("[^0-9]", "", raw))
            if terms:
                for subject in (entity, k):
                    mentions[subject] += 1
                    for w in terms:
                        n[subject, w] += 1
                        sets[subject, w][entity, tuple(x for _, _, x in window)] = terms
    occurs = Counter(w for t in texts for w in folded(t))
    tells = defaultdict(set)
    for (subject, w), held in sets.items():
        p = n[subject, w] / max(occurs[w], n[subject, w])
        prior = min(1.0, mentions[subject] * (2 * near + 1) / total)
        if len(held) < contexts or p < posterior or math.log2(p / prior) < bits:
            continue
        kept = []
        for terms in sorted(held.values(), key=sorted):
            size = lambda x: max(len(terms), len(x))
            if all(size(x) - len(terms & x) >= diversity * size(x) for x in kept):
                kept.append(terms)
        if len(kept) >= contexts:
            tells[w].add(subject if isinstance(subject, int) else "entity")
    said, clean = [], []
    for t, spans, free, mine in zip(texts, found, words_of, close):
        out = [(s, k, e, f"[{kinds[k]}]") for s, k, e in spans]
        for w in free:
            near_kinds = {k for (_, k, _), window in zip(spans, mine) if w in window}
            if "entity" in tells[w[2]]:
                out.append((w[0], 5, w[1], ""))
            elif both := tells[w[2]] & near_kinds:
                out.append((w[0], 5, w[1], f"[{kinds[min(both)]}]"))
        out.sort()
        said.append(",".join(f"{[*kinds, 'term'][k]}:{s}:{e}" for s, k, e, _ in out))
        text, done = "", 0
        for s, _, e, put in out:
            if s >= done:
                text += (t or "")[done:s] + put
            done = max(done, e)
        clean.append(text + (t or "")[done:])
    return said, clean


def told(name, attrs, inside):
    """What tag, role and class say of an element: never text, no article (hint), no article unless one is in it (weak), an
    article's own header (own)."""
    from lectern.llm.html_extract import COMMENTS, CONTENT, HINT_CLASSES, HINT_ROLES, HINT_TAGS, NO_TEXT

    attrs = dict(attrs)
    classes, role = (attrs.get("class") or "").lower(), (attrs.get("role") or "").lower()
    names = [classes, (attrs.get("id") or "").lower()]
    if name in NO_TEXT:
        return "never"
    if name in CONTENT:
        return "hint" if any(x in COMMENTS for n in names for x in re.findall(r"[^\s_-]+", n)) else ""
    if name == "form":
        return "weak"
    if name in HINT_TAGS and not (inside and name == "header"):
        return "hint"
    if role in HINT_ROLES or any(x in HINT_CLASSES for n in names for x in n.split()):
        return "hint"
    if not inside and any(x in HINT_CLASSES for n in names for x in re.findall(r"[^\s_-]+", n)):
        return "weak"
    return "own" if name == "header" and inside else ""


def site_texts(pages, threshold=0.4, balance=0.9, prior=6, hints=False):
    """The texts that a style tree, and hints beside it, leave of (page_id, host, html): well-formed pages of block
    elements, a and b."""
    from html.parser import HTMLParser

    from lectern.llm.html_extract import BRANCHES, FLOW

    class Blocks(HTMLParser):
        def __init__(self, source):
            super().__init__(convert_charrefs=True)
            self.path, self.links, self.blocks, self.children, self.article = [], 0, [[]], defaultdict(list), []
            self.said = [""]
            self.feed(source)
            self.close()

        def handle_starttag(self, tag, attrs):
            if tag in ("a", "b"):
                self.links += tag == "a"
                return
            self.blocks.append([])
            style = ".".join([tag, *(v for k, v in attrs if k == "class")])
            self.children[tuple(self.path)].append(style)
            inside = any(x.split(".")[0] in ("article", "main") for x in self.path)
            mine, above = told(tag, attrs, inside), self.said[-1]
            if (tag in ("article", "main") and not inside and above == "weak") or (above == "own" and re.fullmatch("h[1-6]", tag)):
                above = ""
            self.said.append("never" if "never" in (mine, above) else above or mine)
            self.path.append(style)
            self.children[tuple(self.path)]

        def handle_endtag(self, tag):
            if tag in ("a", "b"):
                self.links -= tag == "a"
                return
            self.path.pop()
            self.said.pop()
            self.blocks.append([])

        def handle_data(self, data):
            if self.said[-1] == "never":
                return
            self.blocks[-1].append((tuple(self.path), self.links > 0, data, self.said[-1] != ""))
            if any(x.split(".")[0] == "article" for x in self.path):
                self.article.append(data)

    squeeze = lambda t: " ".join(t.split())

    def pieces(block):
        for link in (False, True):
            for one in re.split(r"[|·•»\n]+|\s[–—]\s", "".join(t if x == link else "\n" for _, x, t, _ in block)):
                if one := squeeze(one).lower():
                    yield one, link and not (block[0][0] and re.match("h[1-6]", block[0][0][-1]))

    parsed = [(i, host, Blocks(source)) for i, host, source in pages]
    which = {i: squeeze("".join(p.article or [t for b in p.blocks for _, _, t, _ in b])) for i, _, p in parsed}
    having, layouts = defaultdict(set), defaultdict(set)
    for i, host, p in parsed:
        for block in p.blocks:
            for text, link in pieces(block):
                having[host, block[0][0], link, text].add(which[i])
        for path, children in p.children.items():
            layouts[host, path, tuple(children)].add(which[i])
    m, hosts, seen_on = Counter(), defaultdict(set), defaultdict(dict)
    for (host, path, _), pages_of in layouts.items():
        m[host, path] += len(pages_of)
        hosts[path].add(host)
    for (host, path, link, text), pages_of in having.items():
        seen_on[path, link, text][host] = pages_of
    shrunk = lambda value, n, before: ((n - 1) * value + prior * before) / (n - 1 + prior)

    def rarity(n, of):
        return 1 - math.log2(n) / math.log2(of) if of > 1 else 1.0

    importance = {}
    for (host, path, link, text), pages_of in having.items():
        on = seen_on[path, link, text]
        n_hosts = 1 if len(set.union(*on.values())) == 1 else len(on)
        value = min(rarity(len(pages_of), m[host, path]), shrunk(rarity(n_hosts, len(hosts[path])), len(hosts[path]), 1.0))
        importance[host, path, link, text] = 0.0 if link else max(value, 0.0)
    weight, total = Counter(), Counter()
    for key, value in importance.items():
        host, path, _, text = key
        for k in range(len(path) + 1):
            weight[host, path[:k]] += len(having[key]) * len(text)
            total[host, path[:k]] += len(having[key]) * len(text) * value
    raw = {}
    for host, path in m:
        content = total[host, path] / weight[host, path] if weight[host, path] else 1.0
        mine = [(c, len(p)) for (h, q, c), p in layouts.items() if (h, q) == (host, path)]
        n = m[host, path]
        presentation = (math.log2(n) - sum(k * math.log2(k) for _, k in mine) / n) / math.log2(n) if n > 1 else 1.0
        raw[host, path] = balance * content + (1 - balance) * presentation if any(c for c, _ in mine) else content
    elsewhere = {}
    for path, on in hosts.items():
        w = sum(weight[h, path] for h in on)
        elsewhere[path] = shrunk(sum(weight[h, path] * raw[h, path] for h in on) / w if w else 1.0, len(on), 1.0)

    def passed(host, path):
        above = 1.0 if not path else passed(host, path[:-1])
        return shrunk(raw[host, path], m[host, path], min(above, elsewhere[path]))

    def branch(path):
        """What a block is judged with: the last branch above it, within its article if it stands in one."""
        found, inside = (), False
        for k, name in enumerate(x.split(".")[0] for x in path):
            if name in ("article", "main"):
                found, inside = None, True
            elif name in BRANCHES if inside else name not in FLOW:
                found = path[: k + 1]
        return found

    out = {}
    for i, host, p in parsed:
        keep = []
        for block in p.blocks:
            text = squeeze("".join(t for _, _, t, hinted in block if not (hints and hinted)))
            path, own = (block[0][0], list(pieces(block))) if block else ((), [])
            with_ = branch(path)
            if own and with_ is not None and passed(host, path) < threshold and passed(host, with_) < threshold:
                if sum(len(t) * importance[host, path, link, t] for t, link in own) < threshold * sum(len(t) for t, _ in own):
                    continue
            if text:
                keep.append(text)
        out[i] = "\n".join(keep)
    return out


def fill_middle(docs, marks=("<P>", "<S>", "<M>"), rate=90, suffix_first=20):
    out = []
    for i, text in docs:
        text = text or ""
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        if not text or any(x in text for x in marks) or h3 % 100 >= rate:
            out.append((i, n, "plain", None, None, text))
        elif h4 % 100 < suffix_first:
            out.append((i, n, "spm", len(p), len(m), f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}"))
        else:
            out.append((i, n, "psm", len(p), len(m), f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}"))
    return out


def cross(docs, path_a, path_b):
    """Tokens of whole texts, aligned one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    held, pairs, best = [], Counter(), {}
    for i, text in docs:
        x, ids = a.encode(f" {text or ''}", add_special_tokens=False), b.encode(text or "")
        left = [bytes(byte[c] for c in t) for t in x.tokens]
        right = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("\u2581", " ").encode() for k in ids]
        found = []
        if text and b"".join(left) == b"".join(right) == f" {text}".encode():
            j = k = end_a = end_b = 0
            group = [], []
            while j < len(left) or k < len(right):
                if end_a <= end_b:
                    end_a += len(left[j])
                    group[0].append(x.ids[j])
                    j += 1
                else:
                    end_b += len(right[k])
                    group[1].append(ids[k])
                    k += 1
                if end_a == end_b:
                    found.append(group)
                    group = [], []
        links = Counter((p, q) for g, h in found for p in g for q in h)
        pairs.update(links.keys())
        held.append((i, found, links))
    for (p, _), n in pairs.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for i, found, links in held:
        said = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in found)
        liked = sum(n for (p, q), n in links.items() if pairs[p, q] == best[p])
        out.append((i, sum(len(g) for g, _ in found), sum(len(h) for _, h in found), len(found), sum(links.values()), liked, sum(n * pairs[x] for x, n in links.items()), sha(said) if found else ""))
    return out


def verdicts(pages, outcomes, rules, max_bad=0.25, z=1.645):
    """(page_id, host, path, rule, verdict) of (page_id, url); outcomes: page_id to bad."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = []
    for i, url in pages:
        host, path = re.search("://([^/?#]*)([^?#]*)", url).groups() if url and "://" in url else ("", "")
        cut.append((i, host.translate(lower), path))
    n, bad = Counter(), Counter()
    for i, host, _ in cut:
        n[host] += i in outcomes
        bad[host] += outcomes.get(i, False)

    def parts(host):
        bare = re.sub("^[^@]*@", "", re.sub(":[0-9]*$", "", host))
        labels = bare.split(".")
        if re.match(r"^(?:[0-9.]+$|\[)", bare):
            return "", ("", bare)
        k = 2 if ".".join(labels[-2:]) in ("co.uk", "com.au") else 1
        return ".".join(labels[-k:]), (".".join(labels[-k:]), ".".join(labels[-k - 1 :]))

    hosts = {h for _, h, _ in cut}

    def level(prior, groups):
        """The posterior mean of each group (name, prior's name)."""
        sums = {g: (sum(n[h] for h in of), sum(bad[h] for h in of)) for g, of in groups.items()}
        spread = sum((b - k * prior(g)) ** 2 - k * prior(g) * (1 - prior(g)) for g, (k, b) in sums.items())
        room = sum(k * (k - 1) * prior(g) * (1 - prior(g)) for g, (k, b) in sums.items())
        s = 1 / min(max(spread / room, 1 / 10001), 0.5) - 1 if room else 10.0
        return {g: ((b + s * prior(g)) / (k + s), k + s) for g, (k, b) in sums.items()}

    total = sum(n.values())
    by = lambda key: {g: [h for h in hosts if key(h) == g] for g in {key(h) for h in hosts}}
    one = level(lambda g: sum(bad.values()) / total if total else 0.0, by(lambda h: parts(h)[0]))
    two = level(lambda g: one[g[0]][0], by(lambda h: parts(h)[1]))
    last = level(lambda g: two[parts(g)[1]][0], by(lambda h: h))
    out = []
    for i, host, path in cut:
        fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        mean, weight = last[host]
        by_host = "block" if mean - z * math.sqrt(mean * (1 - mean) / (weight + 1)) > max_bad else "allow"
        out.append((i, host, path, max(fit)[3] if fit else None, max(fit)[2] if fit else by_host))
    return out
