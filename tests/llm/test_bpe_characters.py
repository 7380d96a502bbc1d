"""Token ids of every code point against the tokenizers library."""

import public_tokenizers
from tokenizers import Tokenizer

from cairn.llm import bpe


def test_all_code_points():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    library, model = Tokenizer.from_str(spec), bpe.WordBpe(spec)
    library.no_truncation()
    library.no_padding()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f" a{chr(c)}b {chr(c)}{chr(c)}" for c in points[i : i + 60]) for i in range(0, len(points), 60)]
    want = library.encode_batch(texts, add_special_tokens=False)
    wrong = [texts[k] for k, ((ids, _, decoded), w) in enumerate(zip(model.run(texts), want)) if ids.tolist() != w.ids or decoded.decode() != library.decode(w.ids, skip_special_tokens=False)]
    assert not wrong, (len(wrong), [hex(ord(c)) for c in wrong[0]][:400])
