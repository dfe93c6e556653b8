import base64

import pyarrow as pa

from quillspark.llm import bytebpe


def test_decoded_bytes_come_from_the_models_pieces(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)))
    bpe = bytebpe.ByteBpe(str(path), bytebpe.QUICK_FOR)
    ids = lambda b: [i for i, _ in b.coded(["ab é"])][0]
    assert bpe.decode(ids(bpe)) == "ab é".encode()
    wrong = bytebpe.ByteBpe(str(path), bytebpe.QUICK_FOR)
    swapped = [{b"a": b"b", b"b": b"a"}.get(x, x) for x in wrong.bytes_of.to_pylist()]  # an error in the mapping shows
    wrong.bytes_of = pa.array(swapped, pa.binary())
    assert wrong.decode(ids(wrong)) == "ba é".encode()
