import math
import random
import re

from postloom.llm import sanitise


def test_terms_over_whole_documents_by_brute_force(spark):
    r = random.Random(2)
    letters = lambda k: "".join(chr(97 + (k // 26**i) % 26) for i in range(4))
    filler = [f"f{letters(k)}" for k in range(300)]
    names = [f"Zan{letters(k)}" for k in range(8)]
    texts = []
    for k in range(160):
        pad = [" ".join(r.choice(filler) for _ in range(r.choice([1, 40]))) for _ in range(3)]
        who = r.sample(range(8), r.choice([0, 1, 1, 2]))
        texts.append(f"{pad[0]} {' '.join(names[w] for w in who if r.random() < 0.97)} {pad[1]} {' '.join(f'{letters(w)}@corp.example' for w in who)} {pad[2]} again {' '.join(names[w].upper() for w in who)}")
    seen, holds = [], []
    for t in texts:
        mails = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        free = [(m[0].lower(), *m.span()) for m in re.finditer("[A-Za-z]{3,}", t) if not any(m.start() < b and m.end() > a for a, b in mails)]
        seen.append(({t[a:b] for a, b in mails}, free))
        holds.append({m[0].lower() for m in re.finditer("[A-Za-z]{3,}", t)})
    n = len(texts)
    want, far = [], 0
    for t, (ents, free) in zip(texts, seen):
        told = set()
        for e in ents:
            with_e = [k for k, s in enumerate(seen) if e in s[0]]
            for w in {f[0] for f in free}:
                both = sum(any(f[0] == w for f in seen[k][1]) for k in with_e)
                n_t = sum(w in h for h in holds)
                if both >= 3 and math.log2(both * n / (n_t * len(with_e))) >= 0.9 * math.log2(n / len(with_e)):
                    told.add(w)
        want.append(sorted((a, b) for w, a, b in free if w in told))
        far += any(all(abs(a - t.index(e)) > 120 for e in ents) for a, b in want[-1])
    assert far > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: [(s.start, s.end) for s in x.term] for x in sanitise.disclosing(docs).collect()}
    assert [got[k] for k in range(n)] == want
