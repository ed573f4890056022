"""Topics of one session in plain Python, one choice after another."""


def pieces(texts, target):
    """Greedy packing of messages into pieces of at most target characters: (first, last, char from, char to).

    A single message over target is cut at its last line or sentence end past the middle of each piece.
    """
    out = []
    first, held = 0, 0
    for i, text in enumerate(texts):
        if len(text) > target:
            if i > first:
                out.append((first, i - 1, None, None))
            at = 0
            while at < len(text):
                end = min(len(text), at + target)
                if end < len(text):
                    window = text[at:end]
                    stop = max(window.rfind("\n") + 1, window.rfind(". ") + 2 if ". " in window else 0)
                    end = at + stop if stop > target * 0.5 else end
                out.append((i, i, at, end))
                at = end
            first, held = i + 1, 0
        elif held + len(text) > target and i > first:
            out.append((first, i - 1, None, None))
            first, held = i, len(text)
        else:
            held += len(text)
    if first < len(texts):
        out.append((first, len(texts) - 1, None, None))
    return out


def split_session(parts, threshold, max_topics, max_chars, min_chars):
    """(from, to, exchanges, chars, char from, char to, split, agent label, numbers) of the topics of one session's exchanges."""
    score = {p["start"]: p["score"] for p in parts}
    held = []
    for p in parts:
        if held and not (p["score"] is not None and p["score"] >= threshold):
            held[-1].append(p)
        else:
            held.append([p])
    size = lambda s: sum(p["chars"] for p in s)
    while len(held) < 12 * max_topics:
        over = [k for k, s in enumerate(held) if len(s) > 1 and size(s) > max_chars]
        if not over:
            break
        k = max(over, key=lambda i: size(held[i]))
        at = max(range(1, len(held[k])), key=lambda i: held[k][i]["score"])
        held[k : k + 1] = [held[k][:at], held[k][at:]]
    out = []
    for s in held:
        whole = {n: sum(p[n] for p in s) for n in ("chars", "wrote", "substantive", "code_blocks", "errors")}
        base = {"from": s[0]["start"], "to": s[-1]["end"], "n": len(s), "files": 0, "split": False, "a": None, "b": None, "agent": False, **whole}
        if whole["chars"] <= max_chars:
            out.append(base)
            continue
        texts = [t for p in s for t in p["texts"]]
        for first, last, a, b in pieces(texts, max_chars):
            own = texts[first : last + 1] if a is None else [texts[first][a:b]]
            asked = next((p["user_text"] for p in s if p["start"] == s[0]["start"] + first and not a), None)
            share = sum(map(len, own)) / max(1, whole["chars"])
            out.append(
                base | {"from": s[0]["start"] + first, "to": s[0]["start"] + last, "n": last - first + 1, "split": True, "a": a, "b": b, "agent": asked is None, "files": sum(p["n_files"] for p in s) if first == 0 else 0,
                        "chars": sum(map(len, own)), "wrote": round(whole["wrote"] * share), "substantive": sum(len(t.strip()) > 80 for t in own), "code_blocks": sum(t.count("```") for t in own) / 2,
                        "errors": round(whole["errors"] * share)}
            )
    folded = []
    for x in out:
        before = folded[-1] if folded else None
        weak = (score.get(x["from"]) or 0.0) < threshold
        if before and x["chars"] < min_chars and weak and before["chars"] + x["chars"] <= max_chars:
            # Within one message the range goes on; after other messages it is the end of the last one.
            before.update(to=x["to"], b=x["b"], n=before["n"] + x["n"], **{n: before[n] + x[n] for n in ("chars", "wrote", "substantive", "code_blocks", "errors")})
        else:
            folded.append(dict(x))
    return [(x["from"], x["to"], x["n"], x["chars"], x["a"], x["b"], x["split"], x["agent"], x["files"], x["wrote"], x["substantive"], float(x["code_blocks"]), x["errors"]) for x in folded]
