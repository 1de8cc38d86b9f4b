"""Where the small tables for these tests lie."""

SMALL = "/root/testdata/sf0.001"
