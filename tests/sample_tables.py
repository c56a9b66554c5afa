"""Where the tests find the small tables."""

SF_SMALL = "/root/testdata/sf0.001"
