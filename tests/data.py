"""Where the driver's test tables lie."""

SMALL = "/root/testdata/sf0.001"
