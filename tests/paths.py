"""Where the tests' tables lie."""

SF_SMALL = "/root/testdata/sf0.001"
