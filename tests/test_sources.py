"""Files to tables and back: compressed and tiled TIFF, flat and RAW files, registered formats, whole recordings."""

import struct
import zlib

import numpy as np
import pytest

from calspark import settings as S
from calspark.sources import ranges, raw, readers, recording, tiff


def lzw(data):
    """TIFF's LZW, written plainly."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    table, width, word = {bytes((k,)): k for k in range(256)}, 9, b""
    put(256, 9)
    size = 258
    for b in data:
        wide = word + bytes((b,))
        if wide in table:
            word = wide
            continue
        put(table[word], width)
        table[wide] = size
        size += 1
        word = bytes((b,))
        if size == 4095:
            put(table[word], 12)
            put(256, 12)
            table, width, size, word = {bytes((k,)): k for k in range(256)}, 9, 258, b""
        else:
            width = min(12, max(9, size.bit_length()))
    if word:
        put(table[word], width)
    put(257, width)
    put(0, 8)
    return bytes(out)


def packbits(data):
    return b"".join(bytes((min(127, len(data) - k - 1),)) + data[k : k + 128] for k in range(0, len(data), 128)) + b"\x80"


def classic(pages, scheme=1, predictor=1, tile=None, order="<", rows=3):
    """A classic TIFF of uint16 pages in strips of some rows, or tiles."""
    pack = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}[scheme]
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8))

    def squeezed(x):
        if predictor == 2:
            x = np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1)
        return pack(x.astype(order + "u2").tobytes())

    for n, p in enumerate(pages):
        h, w = p.shape
        if tile:
            padded = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), "u2")
            padded[:h, :w] = p
            parts = [squeezed(padded[y : y + tile, x : x + tile]) for y in range(0, h, tile) for x in range(0, w, tile)]
        else:
            parts = [squeezed(p[y : y + rows]) for y in range(0, h, rows)]
        tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [16]), (259, 3, [scheme]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [1])]
        tags += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, None), (325, 4, [len(x) for x in parts])] if tile else [(273, 4, None), (278, 3, [rows]), (279, 4, [len(x) for x in parts])]
        tags.sort()
        extra_at = len(out) + 2 + 12 * len(tags) + 4
        data_at = extra_at + 8 * len(parts)
        starts = np.cumsum([data_at] + [len(x) for x in parts]).tolist()
        entries, extra = b"", b""
        for tag, kind, values in tags:
            values = starts[:-1] if values is None else values
            if kind == 4 and len(values) > 1:
                entries += struct.pack(order + "HHII", tag, kind, len(values), extra_at + len(extra))
                extra += struct.pack(f"{order}{len(values)}I", *values)
            else:
                entries += struct.pack(order + ("HHIHH" if kind == 3 else "HHII"), tag, kind, 1, *([values[0], 0] if kind == 3 else [values[0]]))
        extra += b"\0" * (8 * len(parts) - len(extra))
        out += struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", starts[-1] if n + 1 < len(pages) else 0) + extra + b"".join(parts)
    return bytes(out)


@pytest.mark.parametrize("scheme", [1, 5, 8, 32773])
@pytest.mark.parametrize("form", [{}, {"predictor": 2}, {"tile": 16}, {"tile": 16, "predictor": 2, "order": ">"}])
def test_schemes_and_layouts(scheme, form):
    r = np.random.default_rng(scheme)
    pages = [np.minimum(r.integers(0, 60_000, (37, 41)) // r.choice([1, 400]), 65_535).astype("u2") for _ in range(3)]
    data = classic(pages, scheme, **form)
    got = [tiff.page(data, t) for t in tiff.directories(data)]
    assert len(got) == 3 and all(np.array_equal(a, b) for a, b in zip(got, pages))


def test_lzw_over_many_tables():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype("u1").tobytes() + b"abc" * 30_000
    assert tiff.unlzw(lzw(data)) == data


def test_unknown_schemes_raise():
    data = classic([np.zeros((4, 4), "u2")])
    tags = next(tiff.directories(data))
    with pytest.raises(ValueError, match="scheme 7"):
        tiff.page(data, tags | {259: (7,)})
    with pytest.raises(ValueError, match="3 samples"):
        tiff.page(data, tags | {277: (3,)})


def test_pages_are_read_by_ranges(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(1)
    stack = r.integers(0, 4000, (40, 9, 7)).astype("u2")
    (tmp_path / "a b.tif").write_bytes(classic(stack[:25], 5))
    (tmp_path / "c.tif").write_bytes(classic(stack[25:], 8, predictor=2))
    got = []
    for size in (1, 500, 1 << 20):
        monkeypatch.setattr(ranges, "RANGE_BYTES", size)
        x = tiff.read_pages(spark, str(tmp_path)).toPandas().sort_values(["file", "page"])
        got.append(np.stack(x["arr"]).reshape(-1, 9, 7))
        assert np.array_equal(got[-1], stack // 2)
    monkeypatch.setattr(ranges, "reachable", lambda path: False)
    x = tiff.read_pages(spark, str(tmp_path)).toPandas().sort_values(["file", "page"])
    assert np.array_equal(np.stack(x["arr"]).reshape(-1, 9, 7), got[0])
    with pytest.raises(FileNotFoundError):
        tiff.read_pages(spark, str(tmp_path), "*.none")


@pytest.mark.parametrize("compressed", [False, True])
def test_tiff_files_are_written_and_read(spark, tmp_path, compressed):
    stack = np.random.default_rng(2).integers(-3000, 3000, (2, 23, 6, 5))
    frames = spark.createDataFrame([(p, k, stack[p, k].ravel().tolist()) for p in (0, 1) for k in range(23)], "plane int, frame long, arr array<int>")
    assert tiff.write_tiff_files(frames, str(tmp_path / "out"), 6, 5, 10, compressed) == 6
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names[0] == "plane0_0000000000.tif" and names[-1] == "plane1_0000000020.tif" and len(names) == 6
    x = tiff.read_pages(spark, str(tmp_path / "out")).toPandas().sort_values(["file", "page"])
    assert np.array_equal(np.stack(x["arr"]).reshape(2, 23, 6, 5), stack)


def test_flat_files_by_ranges(spark, tmp_path, monkeypatch):
    stack = np.arange(30 * 4 * 3).reshape(30, 4, 3).astype("<i2")
    (tmp_path / "p2.bin").write_bytes(stack[:11].tobytes())
    (tmp_path / "p10.bin").write_bytes(stack[11:].tobytes() + b"x")
    for size in (50, 1 << 20):
        monkeypatch.setattr(ranges, "RANGE_BYTES", size)
        x = raw.read_flat(spark, str(tmp_path), 4, 3).toPandas().sort_values("frame")
        assert x["frame"].tolist() == list(range(30)) and np.array_equal(np.stack([np.frombuffer(b, "<i2") for b in x["pix"]]).reshape(30, 4, 3), stack)
    monkeypatch.setattr(ranges, "reachable", lambda path: False)
    x = raw.read_flat(spark, str(tmp_path), 4, 3).toPandas().sort_values("frame")
    assert np.array_equal(np.stack([np.frombuffer(b, "<i2") for b in x["pix"]]).reshape(30, 4, 3), stack)


def test_raw_recordings(spark, tmp_path):
    """Two planes and one of flyback, two channels: pages run channel, plane, time."""
    stack = np.arange(5 * 3 * 2 * 4 * 3).reshape(5, 3, 2, 4, 3).astype("<i2")
    (tmp_path / "Image.raw").write_bytes(stack.tobytes())
    (tmp_path / "Experiment.xml").write_text('<E><LSM pixelX="3" pixelY="4"/><Streaming zFastEnable="1" flybackFrames="1" frames="15"/><ZStage steps="2"/><Wavelengths><Wavelength/><Wavelength/></Wavelengths></E>')
    made = recording.convert(spark, S.Recording(data_path=[str(tmp_path)], input_format="raw", nchannels=2), str(tmp_path / "out"))
    assert made.shapes == {0: (4, 3), 1: (4, 3)}
    for channel, table in ((0, made.frames), (1, made.frames2)):
        x = table.toPandas().sort_values(["plane", "frame"])
        assert np.array_equal(np.stack(x["arr"]).reshape(2, 5, 4, 3), stack[:, :2, channel].swapaxes(0, 1))



def test_registered_formats(spark, tmp_path, monkeypatch):
    stack = np.random.default_rng(4).integers(0, 900, (3, 5, 6, 7)).astype("f4")
    np.save(tmp_path / "a.pages", stack)
    (tmp_path / "a.pages.npy").rename(tmp_path / "a.pages")
    monkeypatch.setattr(readers, "FORMATS", dict(readers.FORMATS))

    def opener(path):
        import numpy

        from calspark.sources.readers import _stack

        return _stack(numpy.load(path, mmap_mode="r"))

    readers.register("pages", ("*.pages",), opener)
    x = readers.reader("pages")(spark, str(tmp_path)).toPandas().sort_values("page")
    assert x["page"].tolist() == list(range(15)) and np.array_equal(np.stack(x["arr"]).reshape(stack.shape), stack)
    with pytest.raises(ImportError, match="needs the library"):
        readers.register("other", ("*.o",), opener, "no_such_library")
        readers.reader("other")
    with pytest.raises(FileNotFoundError):
        readers.reader("pages")(spark, [str(tmp_path / "none")] if (tmp_path / "none").mkdir() else str(tmp_path / "none"))


def interleaved(tmp_path, planes, channels, n=6, swap=False):
    stack = np.random.default_rng(7).integers(0, 500, (n, planes, channels, 8, 5)).astype("u2")
    pages = (stack.swapaxes(1, 2) if swap else stack).reshape(-1, 8, 5)
    (tmp_path / "x2.tif").write_bytes(classic(pages[: len(pages) // 2 + 1]))
    (tmp_path / "x10.tif").write_bytes(classic(pages[len(pages) // 2 + 1 :], 5))
    return stack // 2


@pytest.mark.parametrize("swap", [False, True])
@pytest.mark.parametrize("functional", [1, 2])
def test_whole_recordings(spark, tmp_path, swap, functional):
    stack = interleaved(tmp_path, 3, 2, swap=swap)
    made = recording.convert(spark, S.Recording(data_path=[str(tmp_path)], nplanes=3, nchannels=2, functional_chan=functional, swap_order=swap, ignore_flyback=[2]), str(tmp_path / "out"))
    assert made.shapes == {0: (8, 5), 1: (8, 5)}
    for channel, table, means in ((functional - 1, made.frames, made.means), (2 - functional, made.frames2, made.means2)):
        x = table.toPandas().sort_values(["plane", "frame"])
        assert np.array_equal(np.stack(x["arr"]).reshape(2, 6, 8, 5), stack[:, :2, channel].swapaxes(0, 1))
        image = np.zeros((2, 8, 5))
        for m in means.collect():
            image[m.plane, m.y, m.x] = m.v
        assert np.allclose(image, stack[:, :2, channel].mean(0))


def test_fields_of_view_are_planes_of_their_own(spark, tmp_path):
    stack = interleaved(tmp_path, 2, 1)
    made = recording.convert(spark, S.Recording(data_path=[str(tmp_path)], nplanes=2, nrois=2, lines=[[0, 1, 2], [5, 6, 7]]), str(tmp_path / "out"))
    assert made.frames2 is None and made.shapes == {k: (3, 5) for k in range(4)}
    x = made.frames.toPandas().sort_values(["plane", "frame"])
    got = np.stack(x["arr"]).reshape(4, 6, 3, 5)
    for plane in range(2):
        for field, lines in enumerate(([0, 1, 2], [5, 6, 7])):
            assert np.array_equal(got[2 * plane + field], stack[:, plane, 0][:, lines])


def test_files_of_planes_and_channels(spark, tmp_path):
    """One plane and channel a file, planes up and down again."""
    stack = np.random.default_rng(8).integers(0, 500, (8, 2, 4, 5)).astype("u2")  # files, channels
    for k in range(8):
        for c in range(2):
            (tmp_path / f"run_Cycle{k + 1}_Ch{c + 1}_0001.ome.tif").write_bytes(classic([stack[k, c]]))
    made = recording.convert(spark, S.Recording(data_path=[str(tmp_path)], input_format="ome", nplanes=2, nchannels=2, bruker_bidirectional=True), str(tmp_path / "out"))
    x = made.frames.toPandas().sort_values(["plane", "frame"])
    order = [[0, 3, 4, 7], [1, 2, 5, 6]]
    assert np.array_equal(np.stack(x["arr"]).reshape(2, 4, 4, 5), np.stack([stack[o, 0] for o in order]) // 2)
    y = made.frames2.toPandas().sort_values(["plane", "frame"])
    assert np.array_equal(np.stack(y["arr"]).reshape(2, 4, 4, 5), np.stack([stack[o, 1] for o in order]) // 2)


def test_named_files_keep_their_order(spark, tmp_path):
    for name, v in (("b.tif", 2), ("a.tif", 4), ("c.tif", 6)):
        (tmp_path / name).write_bytes(classic([np.full((3, 3), v, "u2")]))
    made = recording.convert(spark, S.Recording(data_path=[str(tmp_path)], file_list=["c.tif", "a.tif"]), str(tmp_path / "out"))
    assert [x.arr[0] for x in made.frames.orderBy("frame").collect()] == [3, 2]
    with pytest.raises(FileNotFoundError):
        recording.sources(S.Recording())
    assert recording.sources(S.Recording(data_path=["/d/"], subfolders=["x", "y"])) == ["/d/x", "/d/y"]
