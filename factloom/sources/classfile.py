"""Facts of one compiled class, read from the class-file format (JVM specification, chapter 4)."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

ACC_INTERFACE, ACC_ABSTRACT, ACC_SYNTHETIC, ACC_BRIDGE, ACC_ANNOTATION, ACC_ENUM = 0x0200, 0x0400, 0x1000, 0x0040, 0x2000, 0x4000
LDC, LDC_W, TABLESWITCH, LOOKUPSWITCH, WIDE, IINC = 18, 19, 170, 171, 196, 132


def _lengths() -> list[int]:
    """Bytes of each instruction, its opcode included; 0 for those of variable length."""
    out = [1] * 256
    for first, last, n in ((16, 16, 2), (17, 17, 3), (18, 18, 2), (19, 20, 3), (21, 25, 2), (54, 58, 2), (132, 132, 3), (153, 168, 3), (169, 169, 2), (178, 184, 3), (185, 186, 5), (187, 187, 3), (188, 188, 2), (189, 189, 3), (192, 193, 3), (197, 197, 4), (198, 199, 3), (200, 201, 5)):
        out[first : last + 1] = [n] * (last - first + 1)
    for op in (TABLESWITCH, LOOKUPSWITCH, WIDE):
        out[op] = 0
    return out


LENGTHS = _lengths()


class BadClass(ValueError):
    pass


def modified_utf8(b: bytes) -> str:
    """NUL is two bytes and characters above U+FFFF are two surrogates of three bytes."""
    text = b.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def type_name(descriptor: str) -> str | None:
    """The Java name of a field descriptor; null for void."""
    dims = len(descriptor) - len(descriptor.lstrip("["))
    d = descriptor[dims:]
    names = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": None}
    base = d[1:-1].replace("/", ".") if d.startswith("L") else names[d]
    return None if base is None else base + "[]" * dims


@dataclass
class Annotation:
    fqn: str
    values: dict

    @property
    def attributes(self) -> str | None:
        return json.dumps(self.values, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if self.values else None


@dataclass
class Method:
    name: str
    descriptor: str
    modifiers: int
    annotations: list[Annotation] = field(default_factory=list)
    strings: list[str] = field(default_factory=list)

    @property
    def return_fqn(self) -> str | None:
        return type_name(self.descriptor[self.descriptor.index(")") + 1 :])


@dataclass
class ClassFacts:
    fqn: str
    kind: str
    super_fqn: str | None
    interfaces: list[str]
    modifiers: int
    source_file: str | None
    annotations: list[Annotation]
    methods: list[Method]
    constants: list[str]

    @property
    def is_abstract(self) -> bool:
        return bool(self.modifiers & ACC_ABSTRACT)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise BadClass("the class is cut off")
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return value

    def u1(self) -> int:
        return self.take(">B")

    def u2(self) -> int:
        return self.take(">H")

    def u4(self) -> int:
        return self.take(">I")

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise BadClass("the class is cut off")
        self.at += n
        return self.data[self.at - n : self.at]


class _Parser:
    def __init__(self, data: bytes):
        self.r = _Reader(data)
        if self.r.u4() != 0xCAFEBABE:
            raise BadClass("not a class file")
        self.r.u4()
        self.pool: dict[int, tuple[int, object]] = {}
        n, i = self.r.u2(), 1
        while i < n:
            tag = self.r.u1()
            if tag == 1:
                self.pool[i] = (tag, modified_utf8(self.r.bytes(self.r.u2())))
            elif tag in (3, 4, 5, 6):
                self.pool[i] = (tag, self.r.take({3: ">i", 4: ">f", 5: ">q", 6: ">d"}[tag]))
            elif tag in (7, 8, 16, 19, 20):
                self.pool[i] = (tag, self.r.u2())
            elif tag in (9, 10, 11, 12, 17, 18):
                self.pool[i] = (tag, self.r.u4())
            elif tag == 15:
                self.pool[i] = (tag, self.r.bytes(3))
            else:
                raise BadClass(f"constant of kind {tag}")
            i += 2 if tag in (5, 6) else 1  # longs and doubles take two places

    def utf8(self, i: int) -> str:
        return self.pool[i][1]

    def name(self, i: int) -> str | None:
        return self.utf8(self.pool[i][1]).replace("/", ".") if i else None

    def attributes(self) -> list[tuple[str, bytes]]:
        return [(self.utf8(self.r.u2()), self.r.bytes(self.r.u4())) for _ in range(self.r.u2())]

    def annotations(self, attributes: list[tuple[str, bytes]]) -> list[Annotation]:
        out = []
        for name, data in attributes:
            if name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
                r = _Reader(data)
                out += [self._annotation(r) for _ in range(r.u2())]
        return out

    def _annotation(self, r: _Reader) -> Annotation:
        fqn = type_name(self.utf8(r.u2()))
        return Annotation(fqn, {self.utf8(r.u2()): self._value(r) for _ in range(r.u2())})

    def _value(self, r: _Reader):
        tag = chr(r.u1())
        if tag == "e":
            r.u2()
            return self.utf8(r.u2())
        if tag == "c":
            return type_name(self.utf8(r.u2())) or "void"
        if tag == "@":
            return self._annotation(r).values
        if tag == "[":
            return [self._value(r) for _ in range(r.u2())]
        value = self.pool[r.u2()][1]
        return chr(value) if tag == "C" else bool(value) if tag == "Z" else value

    def loaded_strings(self, code: bytes) -> list[str]:
        out, at = [], 0
        while at < len(code):
            op = code[at]
            index = code[at + 1] if op == LDC else int.from_bytes(code[at + 1 : at + 3], "big") if op == LDC_W else 0
            if index and self.pool[index][0] == 8:
                out.append(self.utf8(self.pool[index][1]))
            if LENGTHS[op]:
                at += LENGTHS[op]
            elif op == WIDE:
                at += 6 if code[at + 1] == IINC else 4
            else:  # switches are padded to a multiple of four from the method's start
                base = (at + 4) & ~3
                word = lambda k, base=base: int.from_bytes(code[base + 4 * k : base + 4 * k + 4], "big", signed=True)
                at = base + (12 + 4 * (word(2) - word(1) + 1) if op == TABLESWITCH else 8 + 8 * word(1))
        return out

    def parse(self) -> ClassFacts:
        r = self.r
        flags, this, parent = r.u2(), self.name(r.u2()), self.name(r.u2())
        interfaces = sorted(self.name(r.u2()) for _ in range(r.u2()))
        constants = []
        for _ in range(r.u2()):
            r.bytes(6)
            for name, data in self.attributes():
                if name == "ConstantValue":
                    tag, value = self.pool[int.from_bytes(data, "big")]
                    if tag == 8:
                        constants.append(self.utf8(value))
        methods = []
        for _ in range(r.u2()):
            m = Method(modifiers=r.u2(), name=self.utf8(r.u2()), descriptor=self.utf8(r.u2()))
            attributes = self.attributes()
            if m.modifiers & (ACC_SYNTHETIC | ACC_BRIDGE):
                continue
            m.annotations = self.annotations(attributes)
            for name, data in attributes:
                if name == "Code":
                    m.strings = self.loaded_strings(data[8 : 8 + int.from_bytes(data[4:8], "big")])
            methods.append(m)
        attributes = self.attributes()
        source = next((self.utf8(int.from_bytes(d, "big")) for n, d in attributes if n == "SourceFile"), None)
        kind = "annotation" if flags & ACC_ANNOTATION else "interface" if flags & ACC_INTERFACE else "enum" if flags & ACC_ENUM else "record" if any(n == "Record" for n, _ in attributes) else "class"
        return ClassFacts(this, kind, None if parent == "java.lang.Object" else parent, interfaces, flags, source, self.annotations(attributes), methods, constants)


def parse_class(data: bytes) -> ClassFacts:
    try:
        return _Parser(data).parse()
    except (KeyError, IndexError, struct.error, UnicodeDecodeError, TypeError) as e:
        raise BadClass(f"malformed class: {e!r}") from e
