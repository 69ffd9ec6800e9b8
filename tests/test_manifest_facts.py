"""Facts of manifests are those of Python's YAML loader, whichever loader reads them."""

import pandas as pd
import pytest
import yaml

from tesserae.functions import manifests

PLAIN = "apiVersion: policy/v1beta1\nkind: Pod\nmetadata:\n  name: n12"
TEXTS = [
    PLAIN, PLAIN + "\n---\nkind: Node\nmetadata:\n  labels: {}\n", "", " ", "---", "a: b: c", "a:\n - b\n -c", "kind:\tPod", "kind: 'Pod'", "a: [", "a: &x 1\nb: *x", "kind: 2024-01-01", "kind: on\napiVersion: 1e3",
    "kind: 0o7\napiVersion: 010", "- a\n- b: c", ": a", "kind: -\napiVersion: v1", "kind: Pod\nkind: Node", "kind: a:b\napiVersion: http://x/y:z", "metadata: {}\nkind: []", "kind: ~\napiVersion: -x", "kind: Pod\n...\nkind: Node", "kind: Po\x85d", "=: 1\nkind: =",
    "kind: \\x", "--- kind\n--- kind: Pod", "kind: Pod\n  more\napiVersion: v1", "  kind: Pod\n kind: Node", "<<: {}\nkind: Pod",
]


def plain(text):
    try:
        held = [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]
    except yaml.YAMLError as e:
        return str(e), []
    return None, [(*(str(d[k]) if d.get(k) else None for k in ("apiVersion", "kind")), str(m["name"]) if (m := d.get("metadata")) and isinstance(m, dict) and m.get("name") else None) for d in held]


@pytest.mark.parametrize("text", TEXTS)
def test_facts_are_those_of_the_plain_loader(text):
    try:
        want = plain(text)
    except Exception as e:  # what the loader itself cannot build
        with pytest.raises(type(e)):
            manifests._fact(text)
    else:
        assert manifests._fact(text) == want


def test_a_text_is_read_once_and_plain_ones_fast(monkeypatch):
    """Of a thousand rows with four texts, four are read, none of them by Python's own scanner."""
    seen = []
    monkeypatch.setattr(manifests, "_fact", lambda text: seen.append(text) or (None, []))
    texts = pd.Series([[PLAIN + str(i % 4)] for i in range(1000)])
    assert len(manifests._told(texts)) == 1000 and len(seen) == 4
    monkeypatch.undo()
    monkeypatch.setattr(yaml, "safe_load_all", lambda text: pytest.fail("slow loader"))
    assert manifests._fact(PLAIN) == (None, [("policy/v1beta1", "Pod", "n12")])
