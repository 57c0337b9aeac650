"""Small whole pictures, byte by byte."""

_HEX = {
    "wide_png": (
        "89504e 470d0a1a 0a000000 0d494844 52000002 80000000 02080200 00004748 fa8e0000 "
        "001a4944 415478da edc10101 00000082 20ffaf6e 48400100 00c08301 0f020001 fb0d9a4c "
        "00000000 49454e44 ae426082 "
    ),
    "deep_png": (
        "89504e47 0d0a1a0a 0000000d 49484452 00000002 00000002 10060000 002226d1 67000000 "
        "0b494441 5478da63 60200400 00220001 cd1c563c 00000000 49454e44 ae426082 "
    ),
    "palette_png": (
        "89504e 470d0a1a 0a000000 0d494844 52000000 03000000 03080300 000061f6 458d0000 "
        "0003504c 54450102 030d8764 d5000000 0b494441 5478da63 60400000 000c0001 efe83325 "
        "00000000 49454e44 ae426082 "
    ),
    # Start, quantities left out, one frame, stop: a reader of headers needs no more.
    "colour_jpeg": "ffd8 ffc0 0011 08 0002 0003 03 011100 021100 031100 ffd9",
    "grey_progressive_jpeg": "ffd8 ffe0 0004 6162 ffc2 000b 08 0002 0003 01 011100 ffda 0002 00 ffd9",
    "print_jpeg": "ffd8 ff ffc1 0014 08 0010 0020 04 011100 021100 031100 041100 ffd9",
    "odd_jpeg": "ffd8 ffc0 000e 08 0002 0003 02 011100 021100 ffd9",
    "webp": "52494646 10000000 57454250 56503820 04000000 00000000",
    "gif": "474946383961 0200 0300 00 00 00 3b",
}

PICTURES = {name: bytes.fromhex(text) for name, text in _HEX.items()}
PICTURES["svg"] = b'<?xml version="1.0"?>\n<!-- drawn by hand --><s:svg xmlns:s="http://www.w3.org/2000/svg"/>'
PICTURES["cut_png"] = PICTURES["wide_png"][:-9]
PICTURES["cut_webp"] = PICTURES["webp"][:-3]
