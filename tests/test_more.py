import hashlib
import json

import numpy as np
import pytest

from linkquarry import cli
from linkquarry.functions import neural
from linkquarry.operators.verify import VerificationError
from linkquarry.sources import manifests


def weights(kind, e=12, h=20, seed=0):
    r = np.random.default_rng(seed)
    w = {"embedding.weight": r.normal(size=(92, e)), "normalization.weight": np.ones(e), "normalization.bias": np.zeros(e), "output_bias": r.normal(size=92)}
    if kind in ("gru", "local", "lstm"):
        g = 4 if kind == "lstm" else 3
        w |= {"recurrent.weight_ih_l0": r.normal(size=(g * h, e)), "recurrent.weight_hh_l0": r.normal(size=(g * h, h)) * 0.3, "recurrent.bias_ih_l0": r.normal(size=g * h), "recurrent.bias_hh_l0": r.normal(size=g * h), "projection.weight": r.normal(size=(e, h))}
    if kind == "local":
        w |= {"recurrent_projection.weight": r.normal(size=(e, h)), "local_hidden.weight": r.normal(size=(h, 4 * e)), "local_hidden.bias": r.normal(size=h), "local_projection.weight": r.normal(size=(e, h))}
    if kind == "slstm":
        w |= {"input_projection.weight": r.normal(size=(4 * h, e)), "recurrent_projection.weight": r.normal(size=(4 * h, h)) * 0.3, "gate_bias": r.normal(size=4 * h), "output_projection.weight": r.normal(size=(e, h))}
    if kind == "mlp":
        w |= {"hidden.weight": r.normal(size=(h, 8 * e)), "hidden.bias": r.normal(size=h), "output.weight": r.normal(size=(92, h)), "output.bias": r.normal(size=92)}
    if kind == "transformer":
        w |= {"position.weight": r.normal(size=(64, e)), "output.bias": r.normal(size=92)}
        for k in range(2):
            p = f"encoder.layers.{k}."
            w |= {p + "self_attn.in_proj_weight": r.normal(size=(3 * e, e)), p + "self_attn.in_proj_bias": r.normal(size=3 * e), p + "self_attn.out_proj.weight": r.normal(size=(e, e)), p + "self_attn.out_proj.bias": r.normal(size=e)}
            w |= {p + "linear1.weight": r.normal(size=(h, e)), p + "linear1.bias": r.normal(size=h), p + "linear2.weight": r.normal(size=(e, h)), p + "linear2.bias": r.normal(size=e)}
            w |= {f"{p}norm{i}.{n}": v for i in (1, 2) for n, v in (("weight", np.ones(e)), ("bias", np.zeros(e)))}
    return w


MODELS = {"gru": neural.Gru, "local": neural.GruLocal, "lstm": neural.Lstm, "slstm": neural.Slstm, "mlp": neural.Mlp, "transformer": lambda w: neural.Transformer(w, 3)}


@pytest.mark.parametrize("kind", MODELS)
def test_models_are_causal_and_code_exactly(kind):
    model = MODELS[kind](weights(kind))
    a, b = model.logits([91, 3, 4, 5, 6]), model.logits([91, 3, 4, 80, 81])
    assert a.shape == (5, 92) and np.isfinite(a).all() and np.array_equal(a[:3], b[:3]) and not np.allclose(a[3:], b[3:])
    codec = neural.NeuralCodec(model)
    for url in ("", "https://example.com/", "https://e.example/?a=b"):
        assert codec.decode(codec.encode(url)) == url
    assert 0 < neural.url_bits(model, "https://a.b/") < 5000 and model.parameter_sizes()["float32_bytes"] == 4 * model.parameter_sizes()["parameters"]


def test_transformer_by_full_attention():
    w = {k: np.asarray(v, np.float32) for k, v in weights("transformer").items()}
    symbols, e, heads = [91, 5, 9, 33, 2], 12, 3
    norm = lambda x: (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)
    x = w["embedding.weight"][symbols] + w["position.weight"][: len(symbols)]
    for k in range(2):
        p = f"encoder.layers.{k}."
        q, key, value = np.split(norm(x) @ w[p + "self_attn.in_proj_weight"].T + w[p + "self_attn.in_proj_bias"], 3, axis=1)
        out = []
        for i in range(heads):
            s = slice(i * e // heads, (i + 1) * e // heads)
            score = q[:, s] @ key[:, s].T / np.sqrt(e / heads)
            score[np.triu_indices(len(symbols), 1)] = -np.inf
            p_ = np.exp(score - score.max(1, keepdims=True))
            out.append(p_ / p_.sum(1, keepdims=True) @ value[:, s])
        x = x + np.concatenate(out, 1) @ w[p + "self_attn.out_proj.weight"].T + w[p + "self_attn.out_proj.bias"]
        x = x + np.maximum(norm(x) @ w[p + "linear1.weight"].T + w[p + "linear1.bias"], 0) @ w[p + "linear2.weight"].T + w[p + "linear2.bias"]
    assert np.allclose(norm(x) @ w["embedding.weight"].T + w["output.bias"], neural.Transformer(w, heads).logits(symbols), atol=1e-3)


def test_model_scores(spark):
    model = neural.Gru(weights("gru"))
    got = neural.score_bits(spark.createDataFrame([("https://a.b/",), ("x" * 600,)], "url string"), model).collect()
    assert [(r.url, round(r.bits, 3)) for r in got] == [("https://a.b/", round(neural.url_bits(model, "https://a.b/"), 3))]


SOURCE = {"schemaVersion": 1, "id": "main", "crawl": "CC-MAIN-2026-30", "description": "", "index": {"database": "d", "table": "t", "location": "l"}, "sampling": {"profile": "balanced-v1", "seed": "s", "candidateMultiplier": 2, "hostBalancedFraction": 0.8, "maximumUrlsPerHost": 16, "hashBuckets": 1_000_000, "protocols": ["https"], "statuses": [200], "mimeTypes": ["text/html"]}}


def test_source_manifests(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(SOURCE))
    assert manifests.read_source(str(tmp_path / "m.json")).buckets == 1_000_000
    for path, bad in (("schemaVersion", 2), ("id", "A"), ("crawl", "x"), ("sampling.seed", ""), ("sampling.candidateMultiplier", 1), ("sampling.hashBuckets", 10), ("sampling.protocols", ["ftp"]), ("sampling.statuses", []), ("index.table", 3)):
        value = json.loads(json.dumps(SOURCE))
        *above, last = path.split(".")
        (value[above[0]] if above else value)[last] = bad
        with pytest.raises(ValueError):
            manifests.parse_source(value)


def test_fetch_and_storage(tmp_path):
    source, out = tmp_path / "a", tmp_path / "b"
    source.write_bytes(b"data")
    digest = hashlib.sha256(b"data").hexdigest()
    assert manifests.fetch(source.as_uri(), str(out), 4, digest) and not manifests.fetch(source.as_uri(), str(out), 4, digest)
    out.write_bytes(b"other")
    with pytest.raises(ValueError):
        manifests.fetch(source.as_uri(), str(out), 4, digest)
    assert manifests.fetch(source.as_uri(), str(out), 4, digest, force=True)
    with pytest.raises(ValueError):
        manifests.fetch(source.as_uri(), str(tmp_path / "c"), 5, digest)
    manifests.check_storage(str(tmp_path), 100, 1)
    for budget, reserve in ((5, 1), (100, 1 << 60)):
        with pytest.raises(ValueError):
            manifests.check_storage(str(tmp_path), budget, reserve)


def test_command_line(spark, tmp_path):
    (tmp_path / "c.txt").write_text("".join(f"https://h{i % 20}.example/{i}?fbclid=1\n" for i in range(200)) + "bad\n")
    out = str(tmp_path / "out")
    run = lambda *a: cli.main([*a, "--out", out], spark)
    facts = run("all", "--candidate-file", str(tmp_path / "c.txt"), "--count", "100", "--target-shard-bytes", "1KiB")
    assert facts["rows"] == 100 and run("verify") == facts and run("sample", "--candidate-file", "none.txt", "--count", "100")["rows"] == 100
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    manifest["hosts"] += 1
    (tmp_path / "out/manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(VerificationError):
        run("verify")
    (tmp_path / "in.txt").write_text("https://a.example/\nhttps://a.example/?fbclid=2\n\nnope\n")
    got = cli.main(["prepare", "--input", f"x={tmp_path / 'in.txt'}", "--out", str(tmp_path / "p"), "--include-adversarial"], spark)
    assert (got["input"], got["rejected"], got["duplicates"]) == (276, 1, 1)
    with pytest.raises(SystemExit):
        cli.main(["sample", "--count", "3"], spark)
    with pytest.raises(SystemExit):
        cli.main(["pack", "--target-shard-bytes", "0B"], spark)
