"""Redaction leaves nothing of a private key."""

import base64

import numpy as np

from hazmill.llm import secrets


def test_key_bodies_go(spark):
    raw = base64.b64encode(np.random.default_rng(2).bytes(400)).decode()
    lines = [raw[i : i + 64] for i in range(0, len(raw), 64)]
    head, tail = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    whole = "\n".join([head, *lines, tail])
    texts = [
        f"before\n{whole}\nafter this",
        "before\n" + "\n".join([head, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0011", "", *lines]) + "\nafter this",
        'before "' + "\\n".join([head, *lines, tail]) + '" after this',
        f"before\n{whole}\nbetween\n{whole}\nafter this",
        f"before {head} after this",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r["text"] for r in sorted(secrets.redact_secrets(rows).collect())]
    for t in out:
        assert t.startswith("before") and t.rstrip().endswith("after this") and not any(x in t for x in lines) and "KEY" not in t
    assert "between" in out[3]
