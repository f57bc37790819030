"""Schema documents: nodes folded to one nested JSON text per document, and back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPEC = "1.1"
FLAT = "doc_id string, path string, parent_path string, name string, position int, node string"


def to_documents(nodes: DataFrame) -> DataFrame:
    """(doc_id, document) of nodes (doc_id, path, parent_path, name, position, ...): unset fields are left out."""
    rest = [c for c in nodes.columns if c not in ("doc_id", "parent_path", "position")]
    rows = nodes.select("doc_id", "path", "parent_path", "position", F.to_json(F.struct(*rest)).alias("node"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        found = {p: json.loads(n) for p, n in zip(frame["path"], frame["node"])}
        for r in frame.sort_values("position").itertuples():
            if isinstance(r.parent_path, str) and r.parent_path in found:
                found[r.parent_path].setdefault("children", []).append(found[r.path])
        tops = [found[p] for p, up in zip(frame["path"], frame["parent_path"]) if not (isinstance(up, str) and up in found)]
        text = json.dumps({"spec_version": SPEC, "root": tops[0] if len(tops) == 1 else tops}, ensure_ascii=False)
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "document": [text]})

    return rows.groupBy("doc_id").applyInPandas(fold, "doc_id string, document string")


def from_documents(documents: DataFrame) -> DataFrame:
    """FLAT rows of documents (doc_id, document); node holds a node's own fields as JSON."""

    def flatten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in frame.itertuples(index=False):
                root = json.loads(text)["root"]
                stack = [(n, None, i) for i, n in enumerate(root if isinstance(root, list) else [root])]
                while stack:
                    node, up, position = stack.pop()
                    below = node.pop("children", [])
                    rows.append((doc, node["path"], up, node.get("name"), position, json.dumps(node, ensure_ascii=False)))
                    stack += [(c, node["path"], i) for i, c in enumerate(below)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FLAT.split(", ")])

    return documents.select("doc_id", "document").mapInPandas(flatten, FLAT)
