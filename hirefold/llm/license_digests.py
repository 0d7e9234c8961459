"""Canonical digests (``licenses.digest``) of whole licences whose texts are not
stored: the plain text, without its appendix, and copies that differ in the
heading, the appendix or the FSF address."""

from __future__ import annotations

DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "0f126b72e3f0efba47b503509d29c184",
        "1b6603a021d66aa26f436e5d50e5ccb8",
        "25022bd458ef25f2eba08cb1f96b5a27",
        "4545bd2995f8595fb932a3d07393d590",
        "86a1e5b9625978dc0557b3f056913ac1",
        "8b5a25a9afd4fd7ce2760bb838ce53d4",
        "8b70181aee7cd04235c1bd0113ee188d",
        "a0f78d974f1eb939358597294952fece",
        "acfd5016e7da90a295c34c02b5c76e45",
        "b9c130a7c7466083ab708a03aac1bce0",
    ),
    "Apache-2.0 WITH LLVM-exception": (
        "b0acd9906036bfb3e3873574f559a1c0",
    ),
    "Artistic-1.0-Perl": (
        "cca0f6276d1ff39a2431119646fa2422",
    ),
    "BlueOak-1.0.0": (
        "0cdb0983b178906e8ce62b186adb4879",
    ),
    "CC0-1.0": (
        "91002c80cb0ce3b995227677475c54fb",
        "b8f96568d41cdd4c82db001d88c0b4ab",
        "dc68ed5d67c60832f539ea2648d680f5",
    ),
    "GFDL-1.2": (
        "f674e54100ab0c8035e60533bdcba754",
    ),
    "GFDL-1.3": (
        "5e1c94d0db5c7609077d9c2963a11b29",
    ),
    "GPL-1.0": (
        "14b70f5431c2e50ef33c0691750c4312",
        "17eacec7088e92895cda4d6756195b09",
        "22eb280100957b58cb7b85974d3c6ced",
        "931c2e3b52a63141a9b941fef67fcc51",
        "94b758aeacd8a6ed84431ec7551059e8",
        "d4fa1a139e7dbf09ce750c99f7e27c5a",
    ),
    "GPL-2.0": (
        "05ca99618eb30bed6f19b8dda7d87453",
        "085d1d507bc57aa97a0fb84a29309577",
        "0a8e231f4de3f2d897f1269a613de7e9",
        "17a4247e27306f31de7c5d41276dd7b5",
        "19ca99318b2084b7a9cb8d131616b8f8",
        "2b12ce4bb0d4d1712d2df6c21f398dc2",
        "32d3beb0c6f43c1cdce69fd5f802b0d1",
        "45432cef2ed3df0f37c1b6b97b347b64",
        "630127a6dce40a3279e19adb15344111",
        "639609d92a0871d2a02e3417a86cd1b1",
        "6d8e0c81389fb02eec8577dc63d1c2f5",
        "6f68bd1380aec4681ee5dbd22e6a43ee",
        "6fa7df2941c6d38352a238c64e17b7ea",
        "799bc2bf8f64259d014d3b293f012a6f",
        "7c624c51375adca944186ddfe309d28e",
        "7cac100e1e742800ba74c9fe0ec1496b",
        "7d0c6f8d633baae3135ae8dd3ea6c3f6",
        "7dd018d7daeea70c48a501795d688c9d",
        "81ae044b2fc4c9ce660e3eba36d23d8b",
        "82d16dc9f78a9464c6c63ba4be119630",
        "83876596c54958caf4efac68f46acc08",
        "8919fa724dc052893f30615ed91ff0b6",
        "997ad499590ee499bfabec4d90915fa9",
        "ab8fbc5352821912bb29af0f19996fec",
        "b0d7a8001d5b73c9414b79ff63f6505e",
        "e2784a6559c36ce086685e413d50b7d1",
        "e61e1cc63284731e40636112434f980d",
    ),
    "GPL-3.0": (
        "3a55240ab39f903a53fb28b9ade22b5e",
        "40fdb07d9c04a57959bc00b133c882a2",
        "eb14f36d9f18957679702e41d31378b9",
        "f6de2e7df20a69baa33d99dc4b622c40",
    ),
    "LGPL-2.0": (
        "0fe579d43d71b450c05ed133376cd309",
        "2190f1532e6fadc7c0967395b7f267bf",
        "22f5e5d59402c935f039adaeaa705eab",
        "2f4bbd990bb936ef9e01f6656bf17025",
        "304a48e524b6b15e5777e44a0f23e84b",
        "31672b4036faff7ba81b3f2f2c925cfc",
        "31f9800cc163550923c7326654230c65",
        "3690ab4167f03e9511d9fc7a6c96e087",
        "4603ad6bf10057c5632b827b45e81380",
        "5c6b11de9e89ac2448ea31eacfe998c8",
        "64986cec7e88b9524a36832955237a55",
        "90b4e9e4f8adbd5ea8ab4093db282a52",
        "9e4d93195cd93b495cdc5dd4da5a13c5",
        "ade7e1b70be33b8cc3ca1726731e1744",
        "bc62a36aa7672f0868e643cc422a3007",
        "e931d67060dd7191e4002149744f72ec",
    ),
    "LGPL-2.1": (
        "05e14cfced62dbe07ae85171aa3b1813",
        "10b1df8c3fd8255d36c84439350ab1ce",
        "1f04acacee4e8b10f00957802cea3ac3",
        "2185d57439ac28976457c82803be42b3",
        "3b0fc7eb1a6fe18cb643b7023d32de19",
        "6384a1d7da5a2f0cae3da43d2a11546b",
        "64e5587b5187293769f453e552121d82",
        "6d3e0d3d8528ec7688d7060846127e8b",
        "73c441eab2a91e11226d1168942ddf64",
        "7e3a3a4b17e0b8c1261621c843ff3c33",
        "a0c6dc629808b9ea99e5ced9237a92e6",
        "a61e971591cd48b7d54e995ab0276db0",
        "d8a367d2f57f8fe71116c3555e2483b4",
        "db7ed24c8ac131d8d08455541242a555",
        "dbc747dc15c8f055022fcb0ca68a1690",
    ),
    "LGPL-3.0": (
        "b81e3e56d3ca4dd6231a90fa14ac3ce9",
    ),
    "MPL-1.1": (
        "82d520d65452c8fbc6842ef6df4ebf2d",
    ),
    "MPL-2.0": (
        "22d09ba4906211c8fbf8310a5a184380",
        "34a110d697d560a8b2d78ca5587f16d7",
    ),
    "OFL-1.1": (
        "8c8b3190ca5ced172de01a078b852743",
    ),
    "Unlicense": (
        "1ab132403066e82230070398cac277b7",
    ),
}
