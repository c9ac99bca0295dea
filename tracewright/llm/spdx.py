"""Licence identifiers and exceptions, in lower case, by class (see license.py)."""

from __future__ import annotations

_BY_CLASS = {
    0: """0bsd aal adsl afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 apache-1.0 apache-1.1 apache-2.0 apafml artistic-2.0 beerware blessing blueoak-1.0.0 bsd-1-clause
        bsd-2-clause bsd-2-clause-patent bsd-2-clause-views bsd-3-clause bsd-3-clause-attribution bsd-3-clause-clear bsd-3-clause-lbnl bsd-3-clause-modification bsd-3-clause-open-mpi bsd-4-clause
        bsd-4-clause-uc bsd-source-code bsl-1.0 bzip2-1.0.6 caldera cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-pddc cc0-1.0 cdla-permissive-1.0 cdla-permissive-2.0 clartistic cnri-python crossword curl
        doc dsdp ecl-1.0 ecl-2.0 efl-1.0 efl-2.0 entessa fair fsfap fsful fsfullr ftl gl2ps hpnd hpnd-sell-variant ibm-pibs icu ijg imagemagick info-zip intel isc jasper-2.0 json libpng libpng-2.0 libtiff linux-openib
        mir-os mit mit-0 mit-advertising mit-cmu mit-enna mit-feh mit-modern-variant mitnfa mpich2 ms-pl mulanpsl-1.0 mulanpsl-2.0 naist-2003 ncsa net-snmp netcdf newsletr nist-pd nlpl ntp odc-by-1.0 ofl-1.0 ofl-1.1 openssl oldap-2.8 oldap-2.7
        pddl-1.0 php-3.0 php-3.01 plexus postgresql psf-2.0 psutils python-2.0 python-2.0.1 qhull rsa-md ruby saxpath sendmail sgi-b-2.0 smlnj spencer-86 spencer-94 spencer-99 ssh-openssh ssh-short swl tcl tcp-wrappers tmate
        unicode-3.0 unicode-dfs-2015 unicode-dfs-2016 unicode-tou unlicense upl-1.0 vim vsl-1.0 w3c w3c-19980720 w3c-20150513 wtfpl x11 xerox xfree86-1.1 xinetd xnet xpp zed zend-2.0 zlib zlib-acknowledgement zpl-1.1 zpl-2.0 zpl-2.1""",
    1: """apsl-1.0 apsl-1.1 apsl-1.2 apsl-2.0 artistic-1.0 artistic-1.0-perl artistic-1.0-cl8 catosl-1.1 cc-by-nd-4.0 cc-by-nd-3.0 cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-c cpl-1.0 cern-ohl-w-2.0 cdla-sharing-1.0 eclipse-1.0
        ecos-2.0 epl-1.0 epl-2.0 erlpl-1.1 eudatagrid gfdl-1.1-only gfdl-1.1-or-later gfdl-1.2-only gfdl-1.2-or-later gfdl-1.3-only gfdl-1.3-or-later gfdl-1.1 gfdl-1.2 gfdl-1.3 interbase-1.0 ipl-1.0 lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0
        lgpl-3.0-only lgpl-3.0-or-later lgpllr lpl-1.0 lpl-1.02 lppl-1.0 lppl-1.1 lppl-1.2 lppl-1.3a lppl-1.3c motosoto mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-rl nasa-1.3 nokia nosl npl-1.0 npl-1.1 odbl-1.0 osl-1.0 osl-1.1 osl-2.0 osl-2.1 phps rpsl-1.0 sissl sissl-1.2 spl-1.0 sugarcrm-1.1.3 ypl-1.0 ypl-1.1""",
    2: """cecill-1.0 cecill-1.1 cecill-2.0 cecill-2.1 cecill-b cern-ohl-s-2.0 copyleft-next-0.3.0 copyleft-next-0.3.1 eupl-1.0 eupl-1.1 eupl-1.2 gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later
        ofl-1.1-rfn qpl-1.0 sleepycat simpl-2.0 vostrom""",
    3: """agpl-1.0 agpl-1.0-only agpl-1.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later busl-1.1 cc-by-nc-1.0 cc-by-nc-2.0 cc-by-nc-2.5 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-1.0 cc-by-nc-nd-2.0 cc-by-nc-nd-2.5 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0
        cc-by-nc-sa-1.0 cc-by-nc-sa-2.0 cc-by-nc-sa-2.5 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cpal-1.0 elastic-2.0 osl-3.0 parity-6.0.0 parity-7.0.0 polyform-noncommercial-1.0.0 polyform-small-business-1.0.0 rpl-1.1 rpl-1.5 sspl-1.0 watcom-1.0 hippocratic-2.1""",
}
CLASS_OF = {name: kind for kind, names in _BY_CLASS.items() for name in names.split()}
#: What WITH may name; each lets more be linked than its licence alone.
EXCEPTIONS = frozenset(
    """389-exception autoconf-exception-2.0 autoconf-exception-3.0 autoconf-exception-generic bison-exception-1.24 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0 cryptsetup-openssl-exception digirule-foss-exception ecos-exception-2.0
    fawkes-runtime-exception fltk-exception font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gnat-exception gnu-javamail-exception gpl-3.0-linking-exception gpl-3.0-linking-source-exception gpl-cc-1.0 gstreamer-exception-2005 gstreamer-exception-2008 i2p-gpl-java-exception kicad-libraries-exception
    lgpl-3.0-linking-exception libtool-exception linux-syscall-note llgpl llvm-exception lzma-exception mif-exception nokia-qt-exception-1.1 ocaml-lgpl-linking-exception occt-exception-1.0 openjdk-assembly-exception-1.0 openvpn-openssl-exception ps-or-pdf-font-exception-20170817 qt-gpl-exception-1.0
    qt-lgpl-exception-1.1 qwt-exception-1.0 shl-2.0 shl-2.1 swift-exception texinfo-exception u-boot-exception-2.0 universal-foss-exception-1.0 vsftpd-openssl-exception wxwindows-exception-3.1 x11vnc-openssl-exception""".split()
)
#: Notice phrases, in lower case, and the licence each gives notice of.
NOTICES = {
    "released under the mit license": "mit", "licensed under the mit license": "mit", "under the terms of the mit license": "mit", "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "apache license, version 2.0": "apache-2.0", "apache license 2.0": "apache-2.0", "apache license version 2.0": "apache-2.0", "apache software license, version 1.1": "apache-1.1",
    "redistribution and use in source and binary forms, with or without modification": "bsd-3-clause", "licensed under the bsd license": "bsd-3-clause",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this software is provided 'as-is', without any express or implied warranty": "zlib", "boost software license": "bsl-1.0", "python software foundation license": "python-2.0", "do what the fuck you want to public license": "wtfpl",
    "gnu general public license, version 3": "gpl-3.0-only", "gnu general public license, version 2": "gpl-2.0-only", "gnu general public license version 3": "gpl-3.0-only", "gnu general public license version 2": "gpl-2.0-only", "gnu general public license v3": "gpl-3.0-only", "gnu general public license v2": "gpl-2.0-only", "gnu gpl version 2": "gpl-2.0-only", "gnu gpl version 3": "gpl-3.0-only",
    "gnu general public license as published by the free software foundation, either version 3": "gpl-3.0-or-later", "gnu general public license as published by the free software foundation; either version 3": "gpl-3.0-or-later",
    "gnu general public license as published by the free software foundation, either version 2": "gpl-2.0-or-later", "gnu general public license as published by the free software foundation; either version 2": "gpl-2.0-or-later",
    "gnu general public license as published by the free software foundation, version 3": "gpl-3.0-only", "gnu general public license as published by the free software foundation; version 3": "gpl-3.0-only",
    "gnu general public license as published by the free software foundation, version 2": "gpl-2.0-only", "gnu general public license as published by the free software foundation; version 2": "gpl-2.0-only",
    "gnu lesser general public license": "lgpl-3.0-only", "gnu library general public license": "lgpl-2.0-only", "gnu affero general public license": "agpl-3.0-only", "mozilla public license, v. 2.0": "mpl-2.0", "mozilla public license, version 2.0": "mpl-2.0", "mozilla public license version 1.1": "mpl-1.1", "eclipse public license": "epl-2.0",
    "common development and distribution license": "cddl-1.0", "european union public licence": "eupl-1.2", "server side public license": "sspl-1.0", "business source license": "busl-1.1", "open software license": "osl-3.0", "artistic license": "artistic-2.0",
    "cc by-nc 4.0": "cc-by-nc-4.0", "cc by-nc-sa 4.0": "cc-by-nc-sa-4.0", "cc by-nc-nd 4.0": "cc-by-nc-nd-4.0", "cc by-sa 4.0": "cc-by-sa-4.0", "cc by 4.0": "cc-by-4.0", "cc0 1.0 universal": "cc0-1.0",
    "creative commons attribution 4.0 international": "cc-by-4.0", "creative commons attribution-sharealike 4.0 international": "cc-by-sa-4.0", "creative commons attribution-noncommercial 4.0 international": "cc-by-nc-4.0", "creative commons attribution-noncommercial-sharealike 4.0 international": "cc-by-nc-sa-4.0", "creative commons attribution-noncommercial-noderivatives 4.0 international": "cc-by-nc-nd-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
