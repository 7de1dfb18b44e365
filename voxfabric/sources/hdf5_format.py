"""The parts of the HDF5 file format that chunk stores use: groups, chunked and contiguous datasets, deflate.

Reading goes by the addresses in the file, so a caller fetches only the
headers on the way to a dataset, the nodes of its chunk index that a range of
chunks lies under, and those chunks. Superblocks 0 to 3, object headers 1 and
2, groups by symbol tables or compact links, and chunk indexes by version 1
B-trees are known; dense groups and the later chunk indexes are an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from math import prod

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = (1 << 64) - 1
#: Message types.
DATASPACE, DATATYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOLS, LINK_INFO = 0x1, 0x3, 0x5, 0x6, 0x8, 0xB, 0xC, 0x10, 0x11, 0x2
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3

Fetch = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Dataset:
    """Sizes are in the file's order, slowest axis first. chunk is None where values lie in one piece, at address."""

    dims: tuple[int, ...]
    dtype: str
    address: int
    chunk: tuple[int, ...] | None
    filters: tuple[tuple[int, tuple[int, ...]], ...] = ()


@dataclass
class Header:
    messages: list[tuple[int, bytes]] = field(default_factory=list)

    def first(self, kind: int) -> bytes | None:
        return next((m for k, m in self.messages if k == kind), None)


def _pad(n: int) -> int:
    return -(-n // 8) * 8


class File:
    """A file by fetch(offset, length), which returns those bytes."""

    def __init__(self, fetch: Fetch):
        self.fetch = fetch
        head = fetch(0, 96)
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        version = head[8]
        sizes = head[13:15] if version < 2 else head[9:11]
        if version > 3 or tuple(sizes) != (8, 8):
            raise ValueError(f"HDF5 superblock {version} with offsets and lengths of {tuple(sizes)} bytes can't be read")
        if version < 2:
            start = 24 + 4 * version
            self.base, self.root = struct.unpack_from("<Q", head, start)[0], struct.unpack_from("<Q", fetch(start + 32, 16), 8)[0]
        else:
            self.base, _, _, self.root = struct.unpack_from("<4Q", head, 12)

    def at(self, address: int, length: int) -> bytes:
        return self.fetch(self.base + address, length)

    def header(self, address: int) -> Header:
        head = self.at(address, 16)
        return self._header_2(address) if head[:4] == b"OHDR" else self._header_1(address, head)

    def _header_1(self, address: int, head: bytes) -> Header:
        out, (count, _, size) = Header(), struct.unpack_from("<HII", head, 2)
        blocks = [(address + 16, size)]
        while blocks:
            data, at = self.at(*blocks.pop(0)), 0
            while at + 8 <= len(data) and count > 0:
                kind, length = struct.unpack_from("<HH", data, at)
                body, at, count = data[at + 8 : at + 8 + length], at + 8 + length, count - 1
                if kind == CONTINUATION:
                    blocks.append(struct.unpack_from("<QQ", body))
                out.messages.append((kind, body))
        return out

    def _header_2(self, address: int) -> Header:
        out = Header()
        flags = self.at(address, 6)[5]
        at = 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
        width = 1 << (flags & 3)
        size = int.from_bytes(self.at(address + at, width), "little")
        blocks = [(address + at + width, size)]
        while blocks:
            data, at = self.at(*blocks.pop(0)), 0
            while at + 4 + 2 * bool(flags & 4) <= len(data):
                kind, length = struct.unpack_from("<BH", data, at)
                at += 4 + 2 * bool(flags & 4)
                body, at = data[at : at + length], at + length
                if kind == CONTINUATION:  # "OCHK" before, a checksum behind
                    start, n = struct.unpack_from("<QQ", body)
                    blocks.append((start + 4, n - 8))
                if kind:
                    out.messages.append((kind, body))
        return out

    def children(self, address: int) -> dict[str, int]:
        """Names and addresses of a group's members; none if it is no group."""
        header = self.header(address)
        if (table := header.first(SYMBOLS)) is not None:
            tree, heap = struct.unpack_from("<QQ", table)
            _, _, names = struct.unpack_from("<QQQ", self.at(heap, 32), 8)
            size = struct.unpack_from("<Q", self.at(heap, 32), 8)[0]
            return dict(self._symbols(tree, self.at(names, size)))
        info = header.first(LINK_INFO)
        if info is not None and struct.unpack_from("<Q", info, 2 + 8 * (info[1] & 1))[0] != UNDEFINED:
            raise ValueError("groups with dense links can't be read")
        return dict(filter(None, map(self._link, (m for k, m in header.messages if k == LINK))))

    @staticmethod
    def _link(m: bytes) -> tuple[str, int] | None:
        flags, at, kind = m[1], 2, 0
        if flags & 8:
            kind, at = m[2], 3
        at += 8 * bool(flags & 4) + bool(flags & 16)
        width = 1 << (flags & 3)
        n = int.from_bytes(m[at : at + width], "little")
        name = m[at + width : at + width + n].decode()
        return (name, struct.unpack_from("<Q", m, at + width + n)[0]) if kind == 0 else None  # else no link within the file

    def _symbols(self, tree: int, names: bytes) -> Iterator[tuple[str, int]]:
        node = self.at(tree, 24)
        if node[:4] != b"TREE":
            raise ValueError("a group's tree is broken")
        level, used = node[5], struct.unpack_from("<H", node, 6)[0]
        entries = self.at(tree + 24, 16 * used + 8)
        for i in range(used):
            child = struct.unpack_from("<Q", entries, 16 * i + 8)[0]
            if level:
                yield from self._symbols(child, names)
                continue
            count = struct.unpack_from("<H", self.at(child, 8), 6)[0]
            table = self.at(child + 8, 40 * count)
            for j in range(count):
                name, target = struct.unpack_from("<QQ", table, 40 * j)
                yield names[name : names.index(b"\0", name)].decode(), target

    def find(self, path: str) -> int | None:
        """The address of an object by its path, None if there is none."""
        at: int | None = self.root
        for name in filter(None, path.split("/")):
            at = self.children(at).get(name)
            if at is None:
                return None
        return at

    def dataset(self, address: int) -> Dataset | None:
        """The dataset at an address, None if something else is there."""
        header = self.header(address)
        layout, space, kind = header.first(LAYOUT), header.first(DATASPACE), header.first(DATATYPE)
        if layout is None or space is None or kind is None:
            return None
        dims, dtype = _dims(space), _dtype(kind)
        pipeline = header.first(FILTERS)
        filters = tuple(_filters(pipeline)) if pipeline else ()
        if layout[0] != 3:
            raise ValueError(f"data layout {layout[0]} can't be read")
        if layout[1] == 1:
            return Dataset(dims, dtype, struct.unpack_from("<Q", layout, 2)[0], None)
        if layout[1] != 2:
            raise ValueError("compact datasets can't be read")
        n, tree = layout[2], struct.unpack_from("<Q", layout, 3)[0]
        return Dataset(dims, dtype, tree, struct.unpack_from(f"<{n - 1}I", layout, 11), filters)

    def attribute(self, address: int, name: str) -> str | None:
        """A text attribute of an object."""
        for kind, m in self.header(address).messages:
            if kind == ATTRIBUTE:
                version, _, n, type_size, space_size = struct.unpack_from("<BBHHH", m)
                round_ = _pad if version == 1 else int
                at = 8 + (version == 3)
                found, at = m[at : at + n].rstrip(b"\0").decode(), at + round_(n)
                type_, at = m[at : at + type_size], at + round_(type_size)
                value = m[at + round_(space_size) :]
                if found != name:
                    continue
                if type_[0] & 15 == 9:  # of variable length: the text lies in a global heap
                    length, heap, index = struct.unpack_from("<IQI", value)
                    return self._heap_object(heap, index)[:length].decode()
                return value[: struct.unpack_from("<I", type_, 4)[0]].rstrip(b"\0 ").decode()
        return None

    def _heap_object(self, heap: int, index: int) -> bytes:
        data = self.at(heap, struct.unpack_from("<Q", self.at(heap, 16), 8)[0])
        at = 16
        while at + 16 <= len(data):
            number, size = struct.unpack_from("<H", data, at)[0], struct.unpack_from("<Q", data, at + 8)[0]
            if number == index:
                return data[at + 16 : at + 16 + size]
            at += 16 + _pad(size)
        raise ValueError("an object is missing in a global heap")

    def chunks(self, d: Dataset, first: Sequence[int], last: Sequence[int]) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """Offset, address, bytes and filter mask of the stored chunks from first to last (offsets, in the file's order); no other branch of the index is fetched."""
        if d.address != UNDEFINED:
            yield from self._chunks(d.address, len(d.dims), tuple(first), tuple(last))

    def _chunks(self, tree: int, rank: int, first: tuple, last: tuple) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        node = self.at(tree, 24)
        if node[:4] != b"TREE" or node[4] != 1:
            raise ValueError("a chunk index is broken")
        level, used = node[5], struct.unpack_from("<H", node, 6)[0]
        step = 8 + 8 * (rank + 1) + 8
        entries = self.at(tree + 24, step * used + step - 8)
        keys = [struct.unpack_from(f"<II{rank}Q", entries, step * i) for i in range(used + 1)]
        for i in range(used):
            child = struct.unpack_from("<Q", entries, step * i + step - 8)[0]
            size, mask, *offset = keys[i]
            if tuple(offset) > last:
                return
            if level == 0:
                if tuple(offset) >= first:
                    yield tuple(offset), child, size, mask
            elif tuple(keys[i + 1][2:]) > first or i == used - 1:
                yield from self._chunks(child, rank, first, last)

    def values(self, d: Dataset, address: int, size: int, mask: int = 0) -> np.ndarray:
        """A chunk's values, in the dataset's own type."""
        return decode(self.at(address, size), d, mask)

    def box(self, d: Dataset, start: Sequence[int], shape: Sequence[int]) -> np.ndarray:
        """Values of a box of a dataset that lies in one piece: one fetch a run of the last axis."""
        width = np.dtype(d.dtype).itemsize
        out = []
        for i in np.ndindex(*shape[:-1]):
            at = 0
            for s, k, n in zip(start, (*i, 0), d.dims):
                at = at * n + s + k
            out.append(self.at(d.address + at * width, shape[-1] * width))
        return np.frombuffer(b"".join(out), d.dtype)

    def matrix(self, path: str) -> np.ndarray | None:
        """A small dataset whole."""
        address = self.find(path)
        d = None if address is None else self.dataset(address)
        if d is None:
            return None
        if d.chunk is None:
            return np.frombuffer(self.at(d.address, prod(d.dims) * np.dtype(d.dtype).itemsize), d.dtype).reshape(d.dims)
        out = np.zeros(d.dims, d.dtype)
        for offset, at, size, mask in self.chunks(d, (0,) * len(d.dims), d.dims):
            part = self.values(d, at, size, mask).reshape(d.chunk)
            inside = tuple(slice(o, min(o + c, n)) for o, c, n in zip(offset, d.chunk, d.dims))
            out[inside] = part[tuple(slice(0, s.stop - s.start) for s in inside)]
        return out


def _dims(m: bytes) -> tuple[int, ...]:
    return struct.unpack_from(f"<{m[1]}Q", m, 8 if m[0] == 1 else 4)


def _dtype(m: bytes) -> str:
    kind, flags, size = m[0] & 15, m[1], struct.unpack_from("<I", m, 4)[0]
    order = ">" if flags & 1 else "<"
    if kind == 0:
        return f"{order}{'i' if flags & 8 else 'u'}{size}"
    if kind == 1:
        return f"{order}f{size}"
    raise ValueError(f"values of class {kind} can't be read")


def _filters(m: bytes) -> Iterator[tuple[int, tuple[int, ...]]]:
    version, count = m[0], m[1]
    at = 8 if version == 1 else 2
    for _ in range(count):
        number = struct.unpack_from("<H", m, at)[0]
        named = version == 1 or number >= 256
        name = struct.unpack_from("<H", m, at + 2)[0] if named else 0
        _, n = struct.unpack_from("<HH", m, at + 2 + 2 * named)
        at += 6 + 2 * named + (_pad(name) if version == 1 else name)
        yield number, struct.unpack_from(f"<{n}I", m, at)
        at += 4 * n + 4 * (version == 1 and n % 2)


def decode(body: bytes, d: Dataset, mask: int = 0) -> np.ndarray:
    """Filters undone, last first; bit i of mask says that filter i was left out."""
    width = np.dtype(d.dtype).itemsize
    for i, (number, _) in reversed(list(enumerate(d.filters))):
        if mask >> i & 1:
            continue
        if number == DEFLATE:
            body = zlib.decompress(body)
        elif number == SHUFFLE:
            body = np.frombuffer(body, np.uint8).reshape(width, -1).T.tobytes()
        elif number == CHECKSUM:
            body = body[:-4]
        else:
            raise ValueError(f"filter {number} is not known")
    return np.frombuffer(body, d.dtype)


# Writing: pieces are appended, and what points to them follows them, so a file is one stream but for its first 96 bytes.

LEAF, INNER, CHUNK_NODE = 32, 512, 32  # half of the most entries of a symbol table node, and of tree nodes of both kinds


def encode(values: np.ndarray, level: int | None) -> bytes:
    body = values.tobytes()
    return body if level is None else zlib.compress(body, level)


class Writer:
    """append(bytes) gives the place of what it wrote; finish() returns the first 96 bytes, to be put in place of those that begin() left."""

    def __init__(self, write: Callable[[bytes], object]):
        self.write, self.end = write, 0
        self.append(bytes(96))

    def append(self, data: bytes) -> int:
        at = self.end
        data += bytes(-len(data) % 8)
        self.write(data)
        self.end += len(data)
        return at

    def _object(self, messages: Sequence[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHBxxx", kind, _pad(len(m)), 0) + m + bytes(-len(m) % 8) for kind, m in messages)
        return self.append(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def group(self, members: dict[str, int], attributes: dict[str, str] | None = None) -> int:
        names, at = bytearray(8), {}
        for name in sorted(members, key=str.encode):
            at[name] = len(names)
            names += name.encode() + b"\0"
            names += bytes(-len(names) % 8)
        heap = self.end
        self.append(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, heap + 32) + bytes(names))
        ordered = list(at.items())
        keys, tables = [0], []
        for i in range(0, len(ordered), 2 * LEAF):
            some = ordered[i : i + 2 * LEAF]
            rows = b"".join(struct.pack("<QQI20x", place, members[name], 0) for name, place in some)
            tables.append(self.append((b"SNOD" + struct.pack("<BxH", 1, len(some)) + rows).ljust(8 + 80 * LEAF, b"\0")))
            keys.append(some[-1][1])
        if len(tables) > 2 * INNER:
            raise ValueError(f"a group can't have {len(members)} members")
        body = struct.pack("<Q", keys[0]) + b"".join(struct.pack("<QQ", t, k) for t, k in zip(tables, keys[1:]))
        tree = self.append((b"TREE" + struct.pack("<BBHQQ", 0, 0, len(tables), UNDEFINED, UNDEFINED) + body).ljust(24 + 8 + 32 * INNER, b"\0"))
        return self._object([(SYMBOLS, struct.pack("<QQ", tree, heap)), *[(ATTRIBUTE, _text(k, v)) for k, v in (attributes or {}).items()]])

    def matrix(self, values: np.ndarray) -> int:
        """A small dataset in one piece."""
        at = self.append(values.tobytes())
        return self._object([(DATASPACE, _space(values.shape)), (DATATYPE, _type(values.dtype)), (FILL, _NO_FILL), (LAYOUT, struct.pack("<BBQQ", 3, 1, at, values.nbytes))])

    def chunked(self, dims: Sequence[int], chunk: Sequence[int], dtype: str, level: int | None, index: Sequence[tuple[Sequence[int], int, int]]) -> int:
        """A dataset of chunks that were appended: (offset, address, bytes), by offset."""
        tree = self._tree(len(dims), chunk, index)
        width = np.dtype(dtype).itemsize
        layout = struct.pack(f"<BBBQ{len(chunk) + 1}I", 3, 2, len(chunk) + 1, tree, *chunk, width)
        messages = [(DATASPACE, _space(dims)), (DATATYPE, _type(np.dtype(dtype))), (FILL, _NO_FILL), (LAYOUT, layout)]
        if level is not None:
            messages.append((FILTERS, struct.pack("<BB6xHHHH8sII", 1, 1, DEFLATE, 8, 1, 1, b"deflate\0", level, 0)))
        return self._object(messages)

    def _tree(self, rank: int, chunk: Sequence[int], index: Sequence[tuple[Sequence[int], int, int]]) -> int:
        if not index:
            return UNDEFINED
        key = lambda offset, size=0: struct.pack(f"<II{rank + 1}Q", size, 0, *offset, 0)
        beyond = tuple(o + c for o, c in zip(index[-1][0], chunk))
        entries, level, most = [(tuple(o), size, address) for o, address, size in index], 0, 2 * CHUNK_NODE
        size = 24 + (most + 1) * (16 + 8 * rank) + most * 8
        while True:
            nodes = []
            groups = [entries[i : i + most] for i in range(0, len(entries), most)]
            places = [self.end + i * (size + -size % 8) for i in range(len(groups))]
            for i, some in enumerate(groups):
                after = groups[i + 1][0][0] if i + 1 < len(groups) else beyond
                body = b"".join(key(o, n) + struct.pack("<Q", a) for o, n, a in some) + key(after)
                siblings = (places[i - 1] if i else UNDEFINED, places[i + 1] if i + 1 < len(groups) else UNDEFINED)
                nodes.append((some[0][0], some[0][1], self.append((b"TREE" + struct.pack("<BBHQQ", 1, level, len(some), *siblings) + body).ljust(size, b"\0"))))
            if len(nodes) == 1:
                return nodes[0][2]
            entries, level = nodes, level + 1

    def finish(self, root: int) -> bytes:
        head = SIGNATURE + struct.pack("<8BHHI4Q", 0, 0, 0, 0, 0, 8, 8, 0, LEAF, INNER, 0, 0, UNDEFINED, self.end, UNDEFINED)
        return head + struct.pack("<QQI20x", 0, root, 0)


_NO_FILL = struct.pack("<BBBBI", 2, 3, 0, 1, 0)


def _space(dims: Sequence[int]) -> bytes:
    return struct.pack(f"<BBB5x{len(dims)}Q", 1, len(dims), 0, *dims)


def _type(dtype: np.dtype) -> bytes:
    bits, little = dtype.itemsize * 8, dtype.newbyteorder("<")
    if dtype.kind in "iu":
        return struct.pack("<BBBBIHH", 0x10, 8 * (little.kind == "i"), 0, 0, dtype.itemsize, 0, bits)
    exponent, mantissa, bias = {32: (8, 23, 127), 64: (11, 52, 1023)}[bits]
    return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, bits - 1, 0, dtype.itemsize, 0, bits, mantissa, exponent, 0, mantissa, bias)


def _text(name: str, value: str) -> bytes:
    data, named = value.encode() + b"\0", name.encode() + b"\0"
    kind, space = struct.pack("<BBBBI", 0x13, 0, 0, 0, len(data)), struct.pack("<BBB5x", 1, 0, 0)
    return struct.pack("<BxHHH", 1, len(named), len(kind), len(space)) + b"".join(x + bytes(-len(x) % 8) for x in (named, kind, space)) + data
