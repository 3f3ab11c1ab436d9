"""The second grammar as a fold over a document's lines in order: the plain version that the window plan is compared with."""


class Fold:
    """The open group of a document, and the rows of those that were closed."""

    def __init__(self, document_id, year, subject):
        self.document_id, self.year, self.subject = document_id, year, subject
        self.contest = self.round = self.section = None
        self.rows = []
        self.number, self.group = 0, None

    def open(self, block):
        if self.group is None:
            self.group = {"type": self.section or "standard", "year": self.year, "contest": self.contest, "round": self.round, "subject": self.subject, "prompt": None, "items": [], "alone": [], "start": block}
        return self.group

    def close(self, block):
        g, self.group = self.group, None
        if g is None:
            return
        if g["items"]:
            g["items"][-1]["end_block"] = block
        self.number += 1
        common = {"document_id": self.document_id, "group": self.number, "group_type": g["type"], "year": g["year"], "contest": g["contest"], "round": g["round"], "subject": g["subject"], "prompt": g["prompt"], "group_start": g["start"], "group_end": block}
        self.rows.append({**common, "kind": "group"})
        for kind in ("item", "alone"):
            self.rows += [{**common, "kind": kind, "ordinal": k, **x} for k, x in enumerate(g["items" if kind == "item" else "alone"], 1)]

    def line(self, r):
        if r.is_round:
            self.close(r.block - 1)
            self.contest = self.contest if r.round_contest is None else r.round_contest
            self.round, self.section = r.round, r.round_section
        elif r.is_contest:
            self.close(r.block - 1)
            self.contest = r.contest
        elif r.subject is not None:
            self.subject = r.subject
        else:
            self.content(r, self.group)

    def content(self, r, g):
        # An item, once there is one, stays open until its group ends.
        target = None if g is None else g["items"][-1] if g["items"] else g["alone"][-1] if g["alone"] else None
        if target is not None and r.answer is not None:
            target["answer"] = r.answer
        elif target is not None and r.solution is not None:
            target["solution"] = r.solution
        elif r.item_number is not None:
            g = self.open(r.block)
            if g["items"]:
                g["items"][-1]["end_block"] = r.block - 1
            g["items"].append({"number": r.item_number, "question": r.item_text, "answer": None, "solution": None, "images": list(r.images), "start_block": r.block, "end_block": None})
        elif g is not None and g["items"]:
            x = g["items"][-1]
            x["question"] = f"{x['question']} {r.text}".strip()
            if not (g["type"] == "riddle" and r.is_who):
                x["images"] += list(r.images)
        elif g is not None and g["type"] == "riddle" and r.is_who:
            g["prompt"] = r.text
        elif g is not None and g["type"] == "true_false" and g["prompt"] is None:
            g["prompt"] = r.text
        elif r.is_question and (target is None or target["answer"] is not None):
            self.open(r.block)["alone"].append({"question": r.text, "answer": None, "solution": None, "images": [], "start_block": r.block, "end_block": None})
        elif target is not None:
            target["question"] = f"{target['question']} {r.text}"
        else:
            g = self.open(r.block)
            g["prompt"] = r.text if g["prompt"] is None else f"{g['prompt']} {r.text}"


def folded(rows):
    """Rows of classified lines of one document, to its groups, items and questions."""
    rows = sorted(rows, key=lambda r: r.block)
    fold = Fold(rows[0].document_id, rows[0].path_year, rows[0].path_subject)
    for r in rows:
        fold.line(r)
    fold.close(rows[-1].block)
    return fold.rows
