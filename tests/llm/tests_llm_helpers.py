import re


def texts_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def removed_words(rows, size):
    first, out = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        cover = set()
        for p in range(len(w) - size + 1):
            if first.setdefault(tuple(w[p : p + size]), i) < i:
                cover.update(range(p, p + size))
        out[i] = [x for j, x in enumerate(w) if j not in cover]
    return out
