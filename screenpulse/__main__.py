import sys

from screenpulse.plans.cli import main

sys.exit(main())
